"""Row numbers, first-n per group, ordered limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimlens.session import small_side, written

ROWS_PER_BUCKET = 1_000_000
# The driver keeps a few figures of every range, so beyond this number ranges grow instead; they are sorted on disk where they must.
MOST_RANGES = 2_000
# Fixed by monotonically_increasing_id.
PLACE_BITS = 33


def range_count(rows: int, rows_per_bucket: int) -> int:
    return min(MOST_RANGES, -(-rows // rows_per_bucket))


def ranked_rows(
    df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], out: str = "rn", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """``row_number`` within groups of any size, ascending by ``order_by`` (end it with a unique key).

    One count decides the plan. While the largest group fits ``rows_per_bucket`` this is a
    plain window. Otherwise the table is cut into order ranges of about ``rows_per_bucket`` rows, as many as it
    takes (up to MOST_RANGES, then larger ones), and sorted within them: that is the only shuffle of rows. A row's place in its range is noted as it is
    stored, so a lost task cannot cut the ranges anew; its number is that place, less the place of its group's
    first row there, plus the group's rows in earlier ranges. Those are sums of one row per group and range."""
    groups = list(partition_by)
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    seen = sizes.agg(F.sum("_n").alias("total"), F.max("_n").alias("largest")).first()
    if seen["largest"] is None or seen["largest"] <= rows_per_bucket:
        if groups:
            return df.withColumn(out, F.row_number().over(W.partitionBy(*groups).orderBy(*order_by)).cast("long"))
        one = W.partitionBy(F.lit(0)).orderBy(*order_by)
        return df.withColumn(out, F.row_number().over(one).cast("long"))

    ranges = range_count(seen["total"], rows_per_bucket)
    # NULL-safe group key: one struct, never NULL itself.
    keyed = df.withColumn("_g", F.struct(F.lit(0).alias("_"), *groups))
    cut = keyed.repartitionByRange(ranges, *groups, *order_by).sortWithinPartitions(*groups, *order_by)
    # The id is the partition's number above PLACE_BITS and the row's place in it below.
    placed = written(cut.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_at", PLACE_BITS))
    filled = placed.groupBy("_g", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy("_g").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = filled.select("_g", "_range", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    return (
        placed.join(small_side(starts), ["_g", "_range"])
        .withColumn(out, (F.col("_at") + F.col("_start")).cast("long"))
        .select(*df.columns, out)
    )


def top_n_per_group(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column | str], n: int, out: str = "rn") -> DataFrame:
    """First ``n`` rows per group. Each map task trims its groups to ``n`` before the shuffle."""
    number = F.row_number().over(W.partitionBy(*partition_by).orderBy(*order_by))
    return df.withColumn(out, number).filter(F.col(out) <= n)


def first_per_query(df: DataFrame, query: str, order_by: Sequence[Column | str]) -> DataFrame:
    return top_n_per_group(df, [query], order_by, 1, "_first").drop("_first")


def limit_rows(df: DataFrame, order_by: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def slice_rows(df: DataFrame, order_by: Sequence[Column | str], offset: int, n: int) -> DataFrame:
    return df.orderBy(*order_by).offset(offset).limit(n)
