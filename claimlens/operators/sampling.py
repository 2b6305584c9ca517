"""Unions, balanced samples, rare classes, splits. Every draw is a function of the row, never of a seed."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimlens.operators.joins import with_group_counts
from claimlens.operators.windows import top_n_per_group
from claimlens.session import small_side

HASH_BUCKETS = 10_000
COPIES_PER_TASK_ROW = 10_000
HISTOGRAM_DIGITS = 3
ROWS_PER_CUT = 100_000


def union_all(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both, duplicates kept, matched by column name."""
    return first.unionByName(second)


def balanced_exact_n(df: DataFrame, label: str, order_by: list[str], n: int) -> DataFrame:
    """Exactly ``n`` rows of every label that has at least ``n``; other labels vanish.

    Map tasks trim each label to ``n`` rows, and the count runs over what is left in the
    same partitioning, so a hot label never reaches one task."""
    first = top_n_per_group(df.filter(F.col(label).isNotNull()), [label], order_by, n)
    full = first.withColumn("_kept", F.count(F.lit(1)).over(W.partitionBy(label)))
    return full.filter(F.col("_kept") == n).drop("_kept", "rn")


def rare_and_rest(df: DataFrame, label: str, max_count: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows of classes with at most ``max_count`` rows, all other rows)."""
    counted = with_group_counts(df, [label], "_size")
    rare = F.col("_size") <= max_count
    return counted.filter(rare).drop("_size"), counted.filter(~rare).drop("_size")


def repeat_rows(df: DataFrame, times: int | Column, copy: str = "copy") -> DataFrame:
    """Each row ``times`` (1 or more) times, numbered from 1.

    The copies are made in two steps with a shuffle between, so one source row with very
    many copies is spread over the tasks."""
    one, step = F.lit(1).cast("long"), COPIES_PER_TASK_ROW
    often = (F.lit(times) if isinstance(times, int) else times).cast("long")
    if isinstance(times, int) and times <= step:
        return df.withColumn(copy, F.explode(F.sequence(one, often)))
    counted = df.withColumn("_times", often)
    blocks = counted.withColumn("_start", F.explode(F.sequence(one, F.col("_times"), F.lit(step).cast("long"))))
    spread_out = blocks.repartition("_start", *df.columns[:1])
    copies = F.sequence(F.col("_start"), F.least(F.col("_start") + step - 1, F.col("_times")))
    return spread_out.withColumn(copy, F.explode(copies)).drop("_start", "_times")


def oversample_rare(df: DataFrame, label: str, max_count: int = 1) -> DataFrame:
    """Every rare class, of ``max_count`` rows at most, filled up to the size of the largest class; all else once.

    The rows of a rare class share the copies evenly, the first ones in order of their values
    taking one more. ``copy`` numbers the repeats of a row; other rows carry 1."""
    rare, rest = rare_and_rest(df, label, max_count)
    largest = df.filter(F.col(label).isNotNull()).groupBy(label).count().agg(F.max("count")).first()[0] or 0
    once = rest.withColumn("copy", F.lit(1).cast("long"))
    if max_count == 1:
        return union_all(once, repeat_rows(rare, max(largest, 1)))
    # Windows over rare classes alone see ``max_count`` rows at most.
    ordered = W.partitionBy(label).orderBy(*[F.hash(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes])
    size = F.count(F.lit(1)).over(W.partitionBy(label))
    more = (F.row_number().over(ordered) <= F.lit(largest) % size).cast("long")
    shared = rare.withColumn("_copies", F.floor(F.lit(largest) / size) + more)
    return union_all(once, repeat_rows(shared, F.col("_copies")).drop("_copies"))


def hash_order(key: str) -> Column:
    """Order-free position of a row: the md5 of its key."""
    return F.md5(F.col(key).cast("string"))


def hash_cuts(df: DataFrame, label: str, key: str, fraction: float) -> DataFrame:
    """(label, cut_hash, cut_key): the last row of each class within ``fraction`` in hash order.

    A histogram over the first hash digits finds the bucket a class is cut in; only the rows of
    that bucket are put in order. The digits follow the size of the largest class, so that a
    bucket holds ``ROWS_PER_CUT`` rows of it at most, as hashes spread them."""
    hashed = df.select(label, F.col(key).alias("_key"), hash_order(key).alias("_h"))
    largest = df.groupBy(label).count().agg(F.max("count")).first()[0] or 1
    digits = F.substring("_h", 1, max(HISTOGRAM_DIGITS, ceil(log(max(1, largest / ROWS_PER_CUT), 16))))
    counts = hashed.groupBy(label, digits.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    one_class = W.partitionBy(label)
    summed = counts.withColumns(
        {
            "_upto": F.sum("_n").over(one_class.orderBy("_b")),
            "_need": F.ceil(F.lit(fraction) * F.sum("_n").over(one_class)),
        }
    )
    crossed = (F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need"))
    edges = summed.filter(crossed).select(
        F.col(label).alias("_label"), F.col("_b"), (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_left")
    )
    same = (digits == F.col("_b")) & F.col(label).eqNullSafe(F.col("_label"))
    edge_rows = hashed.join(small_side(edges), same, "inner")
    place = F.row_number().over(W.partitionBy("_label").orderBy("_h", "_key"))
    last = edge_rows.withColumn("_place", place).filter(F.col("_place") == F.col("_left"))
    return last.select("_label", F.col("_h").alias("_cut_hash"), F.col("_key").alias("_cut_key"))


def split_stratified(df: DataFrame, label: str, key: str, test_fraction: float, out: str = "is_test") -> DataFrame:
    """Mark ceil(fraction x class size) rows of each class as test, drawn in hash order of the
    unique ``key``. The rows themselves are compared with their class's cut where they lie."""
    cuts = hash_cuts(df, label, key, test_fraction)
    joined = df.join(small_side(cuts), F.col(label).eqNullSafe(F.col("_label")), "left")
    within = F.struct(hash_order(key), F.col(key)) <= F.struct("_cut_hash", "_cut_key")
    chosen = F.col("_cut_hash").isNotNull() & within
    return joined.withColumn(out, F.coalesce(chosen, F.lit(False)).cast("int")).select(*df.columns, out)


def hash_bucket(key: str, buckets: int = HASH_BUCKETS) -> Column:
    return F.conv(F.substring(hash_order(key), 1, 8), 16, 10).cast("long") % buckets


def split_random(df: DataFrame, key: str, train_fraction: float, out: str = "is_train") -> DataFrame:
    """Independent draw per row by hash of its key: the same on any partitioning, no shuffle."""
    return df.withColumn(out, (hash_bucket(key) < int(train_fraction * HASH_BUCKETS)).cast("int"))

