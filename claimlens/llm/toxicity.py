"""Toxicity through a noisy channel: restore disguised words under a character model of the corpus, then score.

1. A character trigram model is counted over all documents.
2. Leetspeak, spaced-out letters and repeated letters span a lattice of readings; Viterbi finds the likeliest.
3. Words and word beginnings of the restored text are held against those that mark labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import held_out, label_sample
from claimlens.session import small_side, spread, written

# The model's alphabet: 0 is whatever is no letter, then a-z, then U+00DF to U+00FF, then any other letter.
LATIN = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SYMBOLS = len(LATIN) + 2
SMOOTHING = 5.0
# What a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c",
}
SEPARATORS = " .-_*'"
# Channel: log probabilities of a substitution, of a stray sign, of a separator, of a repeated letter.
SUBSTITUTED, STRAY, SEPARATED, REPEATED = -1.5, -6.0, -0.1, -0.5
# Bounds of the fit; the model's size depends on these alone.
SAMPLE_ROWS = 20_000
FEATURES = 400
LASSO = 0.0001
LEAST_EVIDENCE = 16.0
STEMS = (4, 5, 6)
LONGEST_WORD = 24
MOST_TIMES = 3
COUNTED = 400_000
REMEMBERED = 200_000

_LETTERS = re.compile(r"[\W\d_]+")
_LEET = re.escape("".join(LEET))
# Letters set apart by single separators; a sign between letters or in front of two, without signs at the end; one letter three times.
_DISGUISED = re.compile(
    rf"(?<![^\W_])(?:[^\W\d_][{re.escape(SEPARATORS)}]){{3,}}[^\W\d_](?![^\W_])"
    rf"|(?<![\w{_LEET}])(?:[^\W\d_]++[{_LEET}]++[^\W\d_]|[{_LEET}]{{1,3}}+[^\W\d_][\w{_LEET}])(?:[\w{_LEET}]*\w)?"
    r"|(?<!\w)(?=\w*?([^\W\d_])\1\1)\w++"
)


def symbol_table() -> np.ndarray:
    """Symbol of every code point up to U+FFFF; letters beyond count as other letters."""
    table = np.array([SYMBOLS - 1 if chr(c).isalpha() else 0 for c in range(0x10000)], np.int64)
    for i, c in enumerate(LATIN):
        table[ord(c)] = i + 1
    return table


def symbols_of(text: str, table: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return table[np.minimum(points, 0xFFFF)]


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts [a, b, c] of character trigrams over all texts, lower-cased.

    Every task adds up whole batches; Spark sums the tasks' counts. The table has a fixed size
    whatever the number of documents, so it can go to every task."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = symbol_table(), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for t in batch["text"]:
                if t:
                    s = np.concatenate([[0, 0], symbols_of(t.lower(), table), [0, 0]])
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3) if len(s) > 20_000 else 0
                    if len(s) <= 20_000:
                        np.add.at(total, (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"trigram": at, "found": total[at]})

    rows = spread(docs.select(F.col(text).alias("text")))
    sums = rows.mapInPandas(counted, "trigram long, found long").groupBy("trigram").agg(F.sum("found").alias("found"))
    counts = np.zeros(SYMBOLS**3)
    for trigram, found in sums.collect():  # at most SYMBOLS ** 3 rows
        counts[trigram] = found
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), smoothed by the share of c among all characters."""
    alone = counts.sum(axis=(0, 1)) + 1.0
    alone /= alone.sum()
    return np.log((counts + SMOOTHING * alone) / (counts.sum(axis=2, keepdims=True) + SMOOTHING)).astype(np.float32)


class Decoder:
    """Restores the disguised words of a text; see ``lattice`` for the readings of a span."""

    def __init__(self, model: np.ndarray):
        self.model, self.number = model, {c: i + 1 for i, c in enumerate(LATIN)}
        self.known: dict[str, str] = {}

    @staticmethod
    def lattice(span: str) -> Iterator[list[tuple[str, float]]]:
        """Per character the (reading, log probability) choices; an empty reading drops the character."""
        for i, c in enumerate(span):
            run = i > 0 and span[i - 1] == c and (span[i - 2 : i - 1] == c or span[i + 1 : i + 2] == c)
            if c.isalpha():
                yield [(c, 0.0), ("", REPEATED)] if run else [(c, 0.0)]
            elif c in LEET:
                yield [*((r, SUBSTITUTED) for r in LEET[c]), ("", REPEATED if run else STRAY)]
            else:
                yield [("", SEPARATED if c in SEPARATORS else STRAY)]

    def best(self, span: str) -> str:
        """The likeliest reading. States are the last two symbols; of equal scores the first found stays."""
        at = self.number.get
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for choices in self.lattice(span):
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, read) in states.items():
                for c, cost in choices:
                    n = at(c, SYMBOLS - 1) if c else b
                    key = (b, n) if c else (a, b)
                    total = score + cost + (float(self.model[a, b, n]) if c else 0.0)
                    if key not in after or total > after[key][0]:
                        after[key] = (total, (read, c) if c else read)
            states = after
        _, read = max(states.items(), key=lambda s: s[1][0] + float(self.model[s[0][0], s[0][1], 0]))[1]
        letters = []
        while read:
            read, c = read
            letters.append(c)
        return "".join(reversed(letters))

    def restored(self, match: re.Match) -> str:
        span = match[0]
        found = self.known.get(span)
        if found is None:
            found = self.best(span)
            if len(span) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[span] = found
        return found

    def words(self, text: str | None) -> str:
        """The text lower-cased and restored, its words set apart by single blanks, one at either end."""
        return f" {_LETTERS.sub(' ', _DISGUISED.sub(self.restored, (text or '').lower()))} ".replace("  ", " ")


def features(words: str) -> Counter:
    """How often whole words ('word ') and beginnings of words ('wor') occur, as they stand after a blank."""
    found = Counter()
    for w, times in Counter(words.split()).items():
        if len(w) <= LONGEST_WORD:
            found[f"{w} "] += times
            for n in STEMS:
                if len(w) >= n:
                    found[w[:n]] += times
    return found


@dataclass
class ToxicityModel:
    """The score is the logistic function of ``bias`` plus the weights of the markers in the restored text.

    A marker is a feature that occurs at least once, at least twice, and so on up to ``MOST_TIMES``."""

    trigrams: np.ndarray
    markers: dict[tuple[str, int], float]
    bias: float


class Scorer:
    def __init__(self, model: ToxicityModel):
        import ahocorasick

        self.decoder, self.model = Decoder(model.trigrams), model
        self.automaton = ahocorasick.Automaton()
        for feature, _ in model.markers:
            self.automaton.add_word(f" {feature}", feature)
        if model.markers:
            self.automaton.make_automaton()

    def marked(self, text: str | None) -> list[tuple[str, int]]:
        """The markers in the restored text."""
        if not self.model.markers:
            return []
        found = Counter(feature for _, feature in self.automaton.iter(self.decoder.words(text)))
        reached = ((feature, i) for feature, times in found.items() for i in range(1, min(times, MOST_TIMES) + 1))
        return [m for m in reached if m in self.model.markers]

    def __call__(self, text: str | None) -> float:
        total = self.model.bias + sum(self.model.markers[m] for m in self.marked(text))
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, total))))


def _evidence(pos, n, all_pos, all_n):
    """Log-likelihood ratio of a feature's documents being labelled as often as all are."""

    def part(k, of, rate):
        return F.when(k > 0, k * F.log(k / (of * rate))).otherwise(F.lit(0.0))

    rate = all_pos / all_n
    return 2 * (part(pos, n, F.lit(rate)) + part(n - pos, n, F.lit(1 - rate)))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    most_features: int = FEATURES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> ToxicityModel:
    """Character model of all documents; markers from at most ``sample_rows`` labelled rows outside the held-out part.

    A marker is a word or a word's beginning, occurring at least so many times, with clear evidence
    (log-likelihood ratio) of marking the labelled documents; the ``most_features`` strongest enter a lasso
    logistic regression, which weighs them against each other. Labels of unknown documents, and rows
    without id or label, have no part. Without labels, or with one kind alone, every score is the smoothed share."""
    trigrams = log_probabilities(trigram_counts(docs, text))
    shared = docs.sparkSession.sparkContext.broadcast(trigrams)
    chosen = small_side(label_sample(labels, label, sample_rows))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = written(texts.join(chosen, "doc_id").select("text", "label"), "sample")
    seen = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    share = (seen["ones"] + 0.5) / (seen["n"] + 1)
    if seen["ones"] in (0, seen["n"]):
        return ToxicityModel(trigrams, {}, math.log(share / (1 - share)))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder, ones, every = Decoder(shared.value), Counter(), Counter()

        def so_far():
            return pd.DataFrame([(f, k, ones[f, k], n) for (f, k), n in every.items()], columns=["feature", "times", "ones", "n"])

        for batch in batches:
            for t, y in zip(batch["text"], batch["label"]):
                found = [(f, i) for f, k in features(decoder.words(t)).items() for i in range(1, min(k, MOST_TIMES) + 1)]
                every.update(found)
                if y:
                    ones.update(found)
                if len(every) > COUNTED:
                    yield so_far()
                    ones.clear()
                    every.clear()
        yield so_far()

    sums = (
        spread(sample).mapInPandas(counted, "feature string, times int, ones long, n long")
        .groupBy("feature", "times").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    )
    strong = (
        sums.withColumn("evidence", _evidence(F.col("ones"), F.col("n"), seen["ones"], seen["n"]))
        .where((F.col("ones") * seen["n"] > F.col("n") * seen["ones"]) & (F.col("evidence") >= LEAST_EVIDENCE) & (F.col("ones") * 2 >= F.col("n")))
        .orderBy(F.desc("evidence"), "feature", "times").limit(most_features).collect()
    )
    found = {(r["feature"], r["times"]): (r["ones"], r["n"]) for r in strong}
    # A beginning that occurs in the documents of a longer marker alone says nothing more.
    markers = sorted(
        (f, times)
        for (f, times), counts in found.items()
        if not any(g != f and k == times and g.startswith(f) and found[g, k] == counts for g, k in found)
    )
    if not markers:
        return ToxicityModel(trigrams, {}, math.log(share / (1 - share)))
    place = docs.sparkSession.sparkContext.broadcast((trigrams, {m: i for i, m in enumerate(markers)}, 0.0))

    @F.pandas_udf("array<double>")
    def flags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(ToxicityModel(*place.value))
        for batch in batches:
            rows = np.zeros((len(batch), len(scorer.model.markers)))
            for row, t in zip(rows, batch):
                row[[scorer.model.markers[m] for m in scorer.marked(t)]] = 1.0
            yield pd.Series(list(rows))

    points = sample.select(array_to_vector(flags("text")).alias("features"), F.col("label").cast("double").alias("label"))
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=80, standardization=False).fit(points)
    weights = {m: float(w) for m, w in zip(markers, fitted.coefficients.toArray()) if w}
    return ToxicityModel(trigrams, weights, float(fitted.intercept))


def _scores(spark, model: ToxicityModel):
    shared = spark.sparkContext.broadcast((model.trigrams, model.markers, model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(ToxicityModel(*shared.value))
        for batch in batches:
            yield batch.map(scorer, na_action=None).astype("float64")

    return score


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, also for an empty or missing text), predicted (1 from ``threshold`` on).

    Rows that repeat are scored each; an empty table gives no rows; further columns are ignored."""
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    scored = rows.select("doc_id", _scores(docs.sparkSession, model)("text").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
