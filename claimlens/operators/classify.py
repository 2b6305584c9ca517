"""Multi-class classifiers on embeddings and on text. Every model is a table, made of counts and sums and applied by joins or products."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.text import BLANK_RUN
from claimlens.operators.search import SCORE_PLACES, list_matrix, topk
from claimlens.session import small_side, written

TERM_BUCKETS = 1 << 14
# Terms per task whose bucket is kept; more are hashed again.
TERMS_KEPT = 1 << 18
# A discriminant's classes and dimensions that may meet on the driver, as numbers of its matrices.
DRIVER_NUMBERS = 16_000_000


def best_of(scores: Column) -> Column:
    """(label, score, probability) of the best of an array of (label, score): highest score, then lowest label.

    The probability is the softmax of the best score among all."""
    ordered = F.array_sort(F.transform(scores, lambda s: F.struct((-F.round(s["score"], SCORE_PLACES)).alias("low"), s["label"].alias("label"), s["score"].alias("score"))))
    top = F.get(ordered, F.lit(0))
    return F.struct(
        top["label"].alias("label"),
        top["score"].alias("score"),
        (1 / F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s["score"] - top["score"]))).alias("probability"),
    )


# --- text -------------------------------------------------------------------------------


def _histograms(buckets: int):
    """Task function: (key, lower-cased text) to one row per key and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        blank = re.compile(BLANK_RUN)

        def bucket(term: str) -> int:
            found = int(md5(term.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % buckets
            if len(known) < TERMS_KEPT:
                known[term] = found
            return found

        for batch in batches:
            rows, places, counts, there = [], [], [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                terms = [c if (c := known.get(w)) is not None else bucket(w) for w in blank.split(text or "") if w]
                place, count = np.unique(np.array(terms or [0], np.int32), return_counts=True)
                rows.append(np.full(len(place), n))
                places.append(place)
                counts.append(count)
                there.append(np.full(len(place), not terms))
            if rows:
                held = pa.array(np.concatenate(places), pa.int32(), mask=np.concatenate(there))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(rows))), held, pa.array(np.concatenate(counts), pa.int64())],
                    names=[batch.schema.field(0).name, "bucket", "n"],
                )

    return run


def term_counts(rows: DataFrame, key: str, text: str, buckets: int = TERM_BUCKETS) -> DataFrame:
    """(key, bucket, n) of the lower-cased terms of whole texts; ``key`` is unique. Write it once, then train and predict from it.

    A term's bucket comes from the first 8 hex digits of its md5. A text without terms has one row without a bucket. A text's terms
    are counted where it lies, without a shuffle."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.lower(F.col(text)).alias("text")).mapInArrow(_histograms(buckets), f"`{key}` {kind}, bucket int, n long")


@dataclass
class TextModel:
    """Multinomial naive Bayes as tables: ``classes`` (label, prior, base), ``terms`` (bucket, label, weight).

    A text's log score of a label is prior + terms x base + the weights of its terms that the label has."""

    classes: DataFrame
    terms: DataFrame


def fit_text_model(counts: DataFrame, labels: DataFrame, key: str, label: str, buckets: int = TERM_BUCKETS, smoothing: float = 1.0) -> TextModel:
    """Train on the texts that ``labels`` (key, label) names, from stored term counts: no text is read again.

    base = ln(a / (terms of the label + a x buckets)), weight = ln((count + a) / a): a term that a label lacks needs no row."""
    known = labels.where(F.col(label).isNotNull()).select(key, F.col(label).alias("label"))
    joined = counts.join(known, key)
    per_term = written(joined.where("bucket is not null").groupBy("label", "bucket").agg(F.sum("n").alias("n")), "term_model")
    sizes = per_term.groupBy("label").agg(F.sum("n").alias("terms"))
    texts = known.groupBy("label").agg(F.count(F.lit(1)).alias("texts"))
    whole = texts.agg(F.sum("texts")).scalar()
    classes = texts.join(sizes, "label", "left").select(
        "label",
        F.log(F.col("texts") / whole).alias("prior"),
        F.log(smoothing / (F.coalesce("terms", F.lit(0)) + smoothing * buckets)).alias("base"),
    )
    terms = per_term.select("bucket", "label", F.log((F.col("n") + smoothing) / smoothing).alias("weight"))
    return TextModel(written(classes, "classes"), terms)


def predict_texts(model: TextModel, counts: DataFrame, key: str) -> DataFrame:
    """(key, predicted_label, score, probability) of every key of ``counts``; no label where the model has none.

    Terms meet the model in an equi-join that broadcasts it only if it is small; a text's weights fold per label in the tasks
    before they move. The class list is one value for all rows."""
    size = counts.groupBy(key).agg(F.sum(F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0)).alias("terms"))
    met = counts.join(small_side(model.terms, computed=True), "bucket")
    sums = met.groupBy(key, "label").agg(F.sum(F.col("n") * F.col("weight")).alias("s"))
    folded = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label", "s"))).alias("known"))
    classes = model.classes.agg(F.array_sort(F.collect_list(F.struct("label", "prior", "base")))).scalar()
    scored = size.join(folded, key, "left").withColumn("classes", classes)
    scores = F.transform(
        "classes",
        lambda c: F.struct(
            c["label"].alias("label"),
            (c["prior"] + F.col("terms") * c["base"] + F.coalesce(F.element_at("known", c["label"]), F.lit(0.0))).alias("score"),
        ),
    )
    best = scored.withColumn("scores", scores).withColumn("best", best_of(F.col("scores")))
    return best.select(key, F.col("best.label").alias("predicted_label"), F.col("best.score").alias("score"), F.col("best.probability").alias("probability"))


# --- embeddings -------------------------------------------------------------------------


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: (label, vector) to one row per label (n, sums) and one row of the products of all pairs of columns."""
    counts: dict[str, list] = {}
    products = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x, labels = list_matrix(batch.column(1)), batch.column(0).to_pandas()
        products = x.T @ x if products is None else products + x.T @ x
        for name, rows in labels.groupby(labels).indices.items():
            held = counts.setdefault(name, [0, 0.0])
            held[0], held[1] = held[0] + len(rows), held[1] + x[rows].sum(0)
    if products is not None:
        names = list(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*names, None], pa.string()),
                pa.array([*(counts[n][0] for n in names), 0], pa.int64()),
                pa.array([*(counts[n][1] for n in names), products.ravel()], pa.list_(pa.float64())),
            ],
            names=["label", "n", "sums"],
        )


@dataclass
class Discriminant:
    """``table`` (label, weights, bias): a vector's score of a label is weights . vector + bias."""

    table: DataFrame


def fit_embedding_classifier(train: DataFrame, vector: str, label: str, ridge: float = 0.01) -> Discriminant:
    """Closed-form linear discriminant: class means, pooled covariance, one solve.

    Each task sums its rows' vectors per class and one matrix of products; the sums are folded in the cluster, so the driver
    gets classes x dimensions + dimensions^2 numbers, whose bound is checked. ``ridge`` adds that share of the mean variance
    to the diagonal. Rows without a label or vector are left out."""
    spark = train.sparkSession
    ready = train.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    parts = ready.select(F.col(label).cast("string"), F.col(vector).cast("array<double>")).mapInArrow(_moments, "label string, n long, sums array<double>")
    folded = parts.select("label", F.lit(-1).alias("at"), F.col("n").cast("double").alias("x")).union(
        parts.select("label", F.posexplode("sums").alias("at", "x"))
    )
    sums = written(folded.groupBy("label", "at").agg(F.sum("x").alias("x")), "moments")
    if (numbers := sums.count()) > DRIVER_NUMBERS:
        raise ValueError(f"{numbers} class and covariance sums do not fit the driver")
    rows = sums.toPandas()
    square = rows[rows["label"].isna() & (rows["at"] >= 0)].sort_values("at")["x"].to_numpy()
    if not len(square):
        return Discriminant(spark.createDataFrame([], "label string, weights array<double>, bias double"))
    d = int(np.sqrt(len(square)))
    known = rows[rows["label"].notna()]
    sizes = known[known["at"] < 0].set_index("label")["x"].sort_index()
    means = known[known["at"] >= 0].pivot(index="label", columns="at", values="x").sort_index().to_numpy() / sizes.to_numpy()[:, None]
    spread = (square.reshape(d, d) - means.T @ (means * sizes.to_numpy()[:, None])) / sizes.sum()
    spread += np.eye(d) * (ridge * np.trace(spread) / d + 1e-12)
    weights = np.linalg.solve(spread, means.T).T
    bias = -0.5 * (weights * means).sum(1) + np.log(sizes.to_numpy() / sizes.sum())
    table = [(name, [float(w) for w in row], float(b)) for name, row, b in zip(sizes.index, weights, bias)]
    return Discriminant(spark.createDataFrame(table, "label string, weights array<double>, bias double"))


def predict_embeddings(model: Discriminant, rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """(keys, predicted_label, score, probability); a row without a vector has no label.

    The model's size is bounded by the fit; products run per batch of rows, without a shuffle."""
    held = model.table.orderBy("label").toPandas()
    shared = rows.sparkSession.sparkContext.broadcast(
        (held["label"].to_numpy(), np.stack(held["weights"]) if len(held) else np.zeros((0, 0)), held["bias"].to_numpy())
    )

    @F.pandas_udf("predicted_label string, score double, probability double")
    def best(vectors: pd.Series) -> pd.DataFrame:
        names, weights, bias = shared.value
        out = pd.DataFrame({"predicted_label": pd.Series([None] * len(vectors), dtype=object), "score": np.nan, "probability": np.nan})
        if (there := np.flatnonzero(vectors.notna())).size and len(names):
            scores = np.stack(vectors.to_numpy()[there]).astype("float64") @ weights.T + bias
            chosen = np.round(scores, SCORE_PLACES).argmax(1)
            top = scores[np.arange(len(there)), chosen]
            out.loc[there, "predicted_label"], out.loc[there, "score"] = names[chosen], top
            out.loc[there, "probability"] = 1 / np.exp(scores - top[:, None]).sum(1)
        return out

    scored = rows.withColumn("_best", best.asNondeterministic()(F.col(vector)))
    return scored.select(*keys, "_best.predicted_label", "_best.score", "_best.probability")


def centroids(train: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, embedding): mean vector per label. Tasks fold their rows to one vector per label."""
    ready = train.filter(F.col(label).isNotNull()).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return ready.groupBy(label).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("embedding"))


def predict_by_centroid(rows: DataFrame, means: DataFrame, label: str, row_id: str, vector: str) -> DataFrame:
    """(row id, predicted_label, score): label of the centroid with the largest dot product."""
    means = written(means, "centroids")
    best = topk(rows, means, 1, query_id=row_id, query_vector=vector, vector_id=label, vector="embedding", exclude_self=False)
    return best.select(F.col("query_id").alias(row_id), F.col("claim_id").alias("predicted_label"), "score")
