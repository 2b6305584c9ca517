"""Counts, text aggregates, correlations, accuracy measures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.operators.windows import slice_rows, top_n_per_group
from claimlens.session import written


def count_by(df: DataFrame, *keys: str, out: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def count_rows(df: DataFrame, out: str = "cnt") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(out))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def count_distinct(df: DataFrame, column: str, out: str = "cnt") -> DataFrame:
    """Number of distinct values; NULL is not one."""
    return df.agg(F.countDistinct(column).alias(out))


def groups_of_size(df: DataFrame, key: str, condition: Column, out: str = "cnt") -> DataFrame:
    """Groups whose row count meets ``condition`` over ``out``."""
    return count_by(df, key, out=out).filter(condition)


def max_class_count(df: DataFrame, key: str, out: str = "max_cnt") -> DataFrame:
    return count_by(df, key).agg(F.max("cnt").alias(out))


def concat_labels(df: DataFrame, label: str, out: str = "labels") -> DataFrame:
    """Distinct lower-cased labels in one sorted, comma-joined string.

    ``collect_set`` folds per task, so what reaches the last task is the label list only."""
    return df.agg(F.array_join(F.array_sort(F.collect_set(F.lower(label))), ",").alias(out))


def concat_examples(
    df: DataFrame, text: Column, order_by: Sequence[str], offset: int, n: int, out: str = "examples"
) -> DataFrame:
    """Numbered block ``"Example 1: ..."`` from ``n`` rows after ``offset`` in key order."""
    rows = slice_rows(df.select(*order_by, text.alias("_text")), order_by, offset, n)
    ordered = F.array_sort(F.collect_list(F.struct(*order_by, "_text")))
    numbered = F.transform(ordered, lambda r, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(": "), r["_text"]))
    return rows.agg(F.array_join(numbered, "\n").alias(out))


# Deviations below this share of what they were taken from are rounding.
ROUNDING = 1e-13
MOMENTS = ("n", "mean_i", "mean_j", "square_i", "square_j", "crossed")


def _co_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: numeric columns to one row per column i: for every column j, over the rows that hold both,
    the count, both means, both sums of squared deviations, and the sum of crossed ones.

    Batches are centred before their products are taken and merged by the deviations of their means, so nothing cancels."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns])
        there = ~np.isnan(x)
        # By a value first, so that a column that does not vary is exactly zero, then by the mean of the rest.
        first = np.where(there.any(0), x[there.argmax(0), np.arange(x.shape[1])], 0)
        x = np.where(there, x - first, 0)
        shift = x.sum(0) / np.maximum(there.sum(0), 1)
        x, shift, there = np.where(there, x - shift, 0), first + shift, there.astype("float64")
        n = there.T @ there
        mean = np.divide(x.T @ there, n, out=np.zeros_like(n), where=n > 0)
        squares = (x * x).T @ there
        own, cross = squares - n * mean**2, x.T @ x - n * mean * mean.T
        own[own <= ROUNDING * squares] = 0
        now = (n, mean + shift[:, None], own, cross)
        held = now if held is None else _merged(held, now)
    if held is not None:
        d = len(held[0])
        n, mean, own, cross = held
        arrays = [pa.array(list(part), pa.list_(pa.float64())) for part in (n, mean, mean.T, own, own.T, cross)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int64()), *arrays], names=["i", *MOMENTS])


def _merged(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    share = np.divide(a[0] * b[0], n, out=np.zeros_like(n), where=n > 0)
    apart = b[1] - a[1]
    mean = np.where(a[0] == 0, b[1], a[1] + apart * np.divide(b[0], n, out=np.zeros_like(n), where=n > 0))
    return n, mean, a[2] + b[2] + apart**2 * share, a[3] + b[3] + apart * apart.T * share


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form (i, j, r), indexes in the order of ``columns``.

    A NULL (or NaN) leaves its row out of the pairs it is in; a column that does not vary gives NaN, a pair without rows NULL. Any
    number of columns takes one scan: each task sums masked products of its rows for all pairs at once, a few
    numbers per pair, which meet by pair in two aggregates (means first, then deviations from them)."""
    names = list(columns)
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{n}") for n, c in enumerate(names)])
    kind = ", ".join(["i long", *[f"{m} array<double>" for m in MOMENTS]])
    parts = written(numbers.mapInArrow(_co_moments, kind), "co_moments")
    cells = parts.select("i", F.posexplode(F.arrays_zip(*MOMENTS)).alias("j", "c")).select("i", F.col("j").cast("long").alias("j"), "c.*").where("n > 0")

    def whole(m: str) -> Column:
        """The parts' common mean; where they agree, exactly that."""
        return F.when(F.min(m) == F.max(m), F.min(m)).otherwise(F.sum(F.col("n") * F.col(m)) / F.sum("n")).alias(f"{m}_all")

    weighted = [whole("mean_i"), whole("mean_j")]
    met = cells.join(cells.groupBy("i", "j").agg(*weighted), ["i", "j"])
    a, b = F.col("mean_i") - F.col("mean_i_all"), F.col("mean_j") - F.col("mean_j_all")
    sums = met.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("square_i") + F.col("n") * a * a).alias("square_i"),
        F.sum(F.col("square_j") + F.col("n") * b * b).alias("square_j"),
        F.sum(F.col("crossed") + F.col("n") * a * b).alias("crossed"),
    )
    spreads = F.sqrt(F.col("square_i")) * F.sqrt(F.col("square_j"))
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.try_divide(F.col("crossed"), spreads))
    measured = F.when(F.col("n") > 0, F.when(spreads > 0, r).otherwise(F.lit(float("nan"))))
    found = sums.select("i", "j", measured.alias("r"))
    every = df.sparkSession.range(len(names)).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(names) - 1).cast("long"))).alias("j"))
    return every.join(found, ["i", "j"], "left")


def correlation_pairs(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower triangle (feature_a, feature_b, r), diagonal left out, named in matrix order."""
    names = F.array(*[F.lit(c) for c in columns])
    return matrix.filter(F.col("i") > F.col("j")).select(
        F.element_at(names, (F.col("i") + 1).cast("int")).alias("feature_a"),
        F.element_at(names, (F.col("j") + 1).cast("int")).alias("feature_b"),
        "r",
    )


def onehot_correlation(df: DataFrame, category: str, numbers: Sequence[str]) -> DataFrame:
    """Correlation (value, feature, r) of each value's indicator with each numeric column.

    No indicator column is built: with p the share of a value among the rows that hold the number,
    r is the distance of its mean from the whole mean in standard deviations, times
    sqrt(p / (1 - p)). A row without a category is in no value's group but in the whole. As in the matrix, what
    does not vary (the number, or the indicator) gives NaN, and a value without numbers NULL. The whole-table figures
    join as one row."""
    whole = df.agg(
        *[F.count(c).alias(f"all_{c}") for c in numbers],
        *[F.avg(c).alias(f"whole_{c}") for c in numbers],
        *[F.stddev_pop(c).alias(f"sd_{c}") for c in numbers],
    )
    groups = df.filter(F.col(category).isNotNull()).groupBy(category).agg(
        *[F.count(c).alias(f"n_{c}") for c in numbers], *[F.avg(c).alias(f"mean_{c}") for c in numbers]
    )

    def measured(c: str) -> Column:
        apart = F.col(f"all_{c}") - F.col(f"n_{c}")
        r = F.try_divide(F.col(f"mean_{c}") - F.col(f"whole_{c}"), F.col(f"sd_{c}")) * F.sqrt(F.try_divide(F.col(f"n_{c}"), apart))
        return F.when(F.col(f"n_{c}") > 0, F.when((F.col(f"sd_{c}") > 0) & (apart > 0), r).otherwise(F.lit(float("nan"))))

    cells = [F.struct(F.lit(c).alias("feature"), measured(c).alias("r")) for c in numbers]
    joined = groups.join(F.broadcast(whole))  # one row
    return joined.select(F.col(category).alias("value"), F.explode(F.array(*cells)).alias("c")).select("value", "c.*")


def retrieved_ids(hits: DataFrame, query: str = "query_id", item: str = "claim_id", rank: str = "rank") -> DataFrame:
    """Per query the ids of its k hits in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("i"))))
    return hits.groupBy(query).agg(F.transform(ordered, lambda s: s["i"]).alias("retrieved"))


def majority_label(hits: DataFrame, query: str = "query_id", label: str = "label", rank: str = "rank") -> DataFrame:
    """Most frequent label per query; ties go to the better rank, then to the lower label."""
    votes = hits.groupBy(query, label).agg(F.count(F.lit(1)).alias("votes"), F.min(rank).alias("best_rank"))
    return top_n_per_group(votes, [query], [F.desc("votes"), "best_rank", label], 1).drop("rn")


def accuracy_percent(actual: str, predicted: str) -> Column:
    """Percent of rows that match exactly; rows without a prediction count as misses."""
    return F.avg(F.col(actual).eqNullSafe(F.col(predicted)).cast("double")) * 100


def weighted_mean(value: str, weight: str) -> Column:
    """NULL where the weights sum to nothing."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def mean_variance(df: DataFrame, score: str) -> DataFrame:
    """Mean and population variance of a per-row score."""
    return df.agg(F.avg(score).alias("mean"), F.var_pop(score).alias("variance"))


def valid_share(condition: Column) -> Column:
    """Percent of rows that meet ``condition``."""
    return F.count_if(condition) * 100.0 / F.count(F.lit(1))

