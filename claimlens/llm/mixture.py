"""Mixing sources to target weights: hash-random keys, ranges, prefix sums, and a cut at each exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.common import WORD
from claimlens.session import small_side, written

ROWS_PER_RANGE = 4_000
KEY_BITS = 60


def words(text: str) -> Column:
    """Number of words of a text column; 0 for a missing text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: str, text: str) -> Column:
    """A 60-bit number that depends on the id alone (on the text where there is no id), so reruns agree."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit("")))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size, rows) with each source's ``target``.

    Sources in code point order (null last) weigh ``weights``, repeating, and share ``share`` of
    all words. A source stops at ``repeats`` times its size and its excess goes to the others by
    weight, until none is above: that is a common level, target = min(limit, level * weight),
    found from the sources in the order in which a rising level stops them. The windows see
    one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    stopping = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = stopping.rowsBetween(Window.unboundedPreceding, -1)
    pattern = F.array(*[F.lit(w) for w in weights])
    ranked = totals.withColumns(
        {
            "weight": F.element_at(pattern, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")),
            "limit": F.col("source_size") * repeats,
        }
    )
    stepped = ranked.withColumn("position", F.row_number().over(stopping)).withColumn(
        "level",
        (
            F.lit(float(share)) * F.sum("source_size").over(everything)
            - F.coalesce(F.sum("limit").over(before), F.lit(0))
        )
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    holds = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("position"))
    level = F.min_by("level", holds).over(everything)
    target = F.least(F.col("limit").cast("double"), F.coalesce(level * F.col("weight"), F.col("limit").cast("double")))
    return stepped.withColumn("target", target).select("source", "source_size", "rows", "target")


def same_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on the source, null matching null."""
    named = right.withColumnRenamed("source", "_source")
    return left.join(named, left["source"].eqNullSafe(named["_source"])).drop("_source")


def range_of(key: str, ranges: str) -> Column:
    """Which of a source's equal-width key ranges a row is in."""
    half = KEY_BITS // 2
    return F.shiftright(F.shiftright(F.col(key), half) * F.col(ranges), half)


def cuts(sized: DataFrame, weights: tuple, share: float, repeats: int, rows_per_range: int) -> DataFrame:
    """Per source: its size, target, whole epochs, the rest, and the key range in which the rest ends.

    The ranges of a source hold about ``rows_per_range`` rows each, so a source of any size is
    summed in parallel; the running sum over ranges sees one row per range."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    budget = F.floor("target").cast("long")
    per_source = written(
        targets(totals, weights, share, repeats)
        .withColumn("ranges", F.ceil(F.col("rows") / rows_per_range).cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size")),
        "sources",
    )
    ranged = same_source(sized, small_side(per_source, computed=True)).withColumn("range", range_of("key", "ranges"))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    running = Window.partitionBy("source").orderBy("range")
    upto = sums.withColumn("upto", F.sum("words").over(running))
    ends = (
        upto.where(F.col("upto") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("base"))).alias("cut"))
        .select("source", F.col("cut.range").alias("cut_range"), F.col("cut.base").alias("base"))
    )
    named = ends.withColumnRenamed("source", "_source")
    joined = per_source.join(named, per_source["source"].eqNullSafe(named["_source"]), "left").drop("_source", "rows")
    return written(joined, "cuts")


def mix(
    docs: DataFrame,
    weights: tuple = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: tuple = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Returns ``doc_id``, ``size`` (words), ``source_size``, ``target`` (its source's), ``taken``, and
    the columns named in ``carry`` (any but those five names). Each source takes exactly
    floor(target) words: whole epochs, then documents in order of a random key up to the budget;
    the document at the cut is taken in part. Only the key range of the cut is sorted.

    A missing text counts 0 words and is never taken; null is a source of its own; repeated rows
    count each; an empty table gives no rows; further columns are ignored."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        words(text).alias("size"),
        random_key(doc_id, text).alias("key"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("nothing")]).alias("carried"),
    )
    narrow = written(rows.drop("carried"), "sizes")
    per_source = small_side(cuts(narrow, weights, share, repeats, rows_per_range), computed=True)
    placed = same_source(rows if carry else narrow.withColumn("carried", F.lit(None)), per_source).withColumn(
        "range", range_of("key", "ranges")
    )
    cut = F.col("range") == F.col("cut_range")
    whole = placed.where(~F.coalesce(cut, F.lit(False))).withColumn(
        "last", F.when(F.coalesce(F.col("range") < F.col("cut_range"), F.col("rest") > 0), F.col("size")).otherwise(0)
    )
    order = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    earlier = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parted = (
        placed.where(cut)
        .withColumn("earlier", F.col("base") + earlier)
        .withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("earlier"))))
        .drop("earlier")
    )
    out = whole.unionByName(parted)
    kept = [F.col(f"carried.{c}").alias(c) for c in carry if c != "doc_id"]
    taken = (F.col("epochs") * F.col("size") + F.col("last")).cast("long").alias("taken")
    return out.select("doc_id", "size", "source_size", "target", taken, *kept)
