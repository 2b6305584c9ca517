"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into column expressions.

Trees are grown on statistics of a bounded sample of labelled rows; every path from a root is a
conjunctive rule; a lasso logistic regression keeps few of the rules; the kept ones become one
Spark expression, so scoring is a scan without Python, shuffles or collected rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import WORD, held_out, label_sample, whole_text
from claimlens.session import small_side, written

# Bounds of the fit; the model's size depends on these alone.
SAMPLE_ROWS = 20_000
TREES = 12
DEPTH = 3
LASSO = 0.002


def statistics(whole: Column, words: Column) -> dict[str, Column]:
    """Shares made of counts of one text and its words; all are 0 for an empty text."""
    chars, n_words = F.length(whole), F.size(words)

    def without(characters: str) -> Column:
        return chars - F.length(F.regexp_replace(whole, f"[{characters}]+", ""))

    def share(count: Column, of_what: Column) -> Column:
        return F.when(of_what > 0, count / of_what).otherwise(F.lit(0.0))

    return {
        "n_words": n_words.cast("double"),
        "word_length": share(F.length(F.array_join(words, "")), n_words),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "symbols": share(without("#*$%&|<>"), chars),
        "bars": share(chars - F.length(F.replace(whole, F.lit("|"), F.lit(""))), n_words),
        "upper": share(without("A-Z"), chars),
        "digits": share(without("0-9"), chars),
        "calls": share(chars - F.length(F.replace(whole, F.lit("!"), F.lit(""))), n_words),
        "stops": share(without(".?,;:"), n_words),
        "lines": share(chars - F.length(F.replace(whole, F.lit("\n"), F.lit(""))), n_words),
    }


STATISTICS = ("n_words", "word_length", "distinct_words", "symbols", "bars", "upper", "digits", "calls", "stops", "lines")


def measured(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with one ``stats`` struct. The array of one text binds its words once for all that is counted of them."""
    whole = whole_text(text)
    words = F.array(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)))
    stats = F.transform(words, lambda w: F.struct(*[c.cast("double").alias(name) for name, c in statistics(whole, w).items()]))
    return rows.withColumn("stats", F.get(stats, F.lit(0)))


@dataclass
class RuleModel:
    """A score is the logistic function of ``bias`` plus the weights of the rules that hold.

    A rule is a tuple of (statistic, at_most, threshold): the statistic is at most the threshold, or above it."""

    bias: float
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]] = field(default_factory=list)

    def score(self, stats: str = "stats") -> Column:
        """The array of one struct binds the statistics once, however many rules look at them."""

        def scored(bound: Column) -> Column:
            total = F.lit(self.bias)
            for conditions, weight in self.rules:
                total += F.when(holds(conditions, bound), F.lit(weight)).otherwise(F.lit(0.0))
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

        return F.get(F.transform(F.array(stats), scored), F.lit(0))


def holds(conditions, stats: Column) -> Column:
    test = F.lit(True)
    for name, at_most, threshold in conditions:
        value = stats[name]
        test &= (value <= threshold) if at_most else (value > threshold)
    return test


def paths(tree) -> list[tuple[tuple[str, bool, float], ...]]:
    """Every path from the root of a fitted tree to another node, as a conjunction."""
    found, work = [], [(tree._java_obj.rootNode(), ())]
    while work:
        node, above = work.pop()
        if above:
            found.append(above)
        if node.numDescendants() > 0:
            split = node.split()
            name, threshold = STATISTICS[split.featureIndex()], float(split.threshold())
            work.append((node.leftChild(), (*above, (name, True, threshold))))
            work.append((node.rightChild(), (*above, (name, False, threshold))))
    return found


def distinct_rules(trees: list) -> list[tuple[tuple[str, bool, float], ...]]:
    """The rules of all trees, each once, conditions in one order."""
    return sorted({tuple(sorted(set(path))) for tree in trees for path in paths(tree)})


def fit(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> RuleModel:
    """A model of (stats, label) rows. Without rows it gives 0.5; with one label alone its smoothed share."""
    seen = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    share = (seen["ones"] + 1) / (seen["n"] + 2)
    if seen["ones"] in (0, seen["n"]):
        return RuleModel(math.log(share / (1 - share)))
    vectors = VectorAssembler(inputCols=[f"stats.{c}" for c in STATISTICS], outputCol="features")
    points = vectors.transform(sample).select("features", "stats", F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, minInstancesPerNode=3).fit(points)
    rules = distinct_rules(forest.trees)
    if not rules:
        return RuleModel(math.log(share / (1 - share)))
    flags = points.select("label", *[holds(r, F.col("stats")).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    inputs = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(flags)
    lassoed = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(inputs)
    weighted = [(r, float(w)) for r, w in zip(rules, lassoed.coefficients.toArray()) if w]
    return RuleModel(float(lassoed.intercept), weighted)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> RuleModel:
    """A model of the labelled documents outside the held-out part, from at most ``sample_rows`` of them.

    Only the text goes into the statistics. Labels of unknown documents, and rows without id or label, have no part."""
    chosen = small_side(label_sample(labels, label, sample_rows))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = measured(texts.join(chosen, "doc_id").drop("doc_id"))
    # One order of the rows, whatever the files' order, so that fits agree between runs.
    return fit(written(sample.select("stats", "label").repartition(4, "stats").sortWithinPartitions("stats", "label"), "sample"))


def quality_scores(docs: DataFrame, model: RuleModel, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, also for an empty or missing text), predicted (1 from ``threshold`` on).

    Rows that repeat are scored each; an empty table gives no rows; further columns are ignored."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = measured(texts).withColumn("score", model.score())
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The documents that score at least ``threshold``, whole and with all their columns."""
    carried = docs.select(F.col(text).alias("text"), F.struct("*").alias("row"))
    return measured(carried).where(model.score() >= threshold).select("row.*")
