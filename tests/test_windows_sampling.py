import random
from collections import Counter

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimlens.operators import features, joins, sampling, windows


def skewed(spark, n=600):
    """A third of all rows in one group, a NULL group, repeated order values."""
    rnd = random.Random(1)
    rows = []
    for i in range(n):
        group = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", None])
        rows.append((i, group, rnd.randrange(20)))
    return spark.createDataFrame(rows, "id long, g string, v int").repartition(5)


def test_ranges_do_not_grow_in_number_without_end(spark, monkeypatch):
    """What the driver hears of each range stays bounded; rows are numbered as before."""
    assert windows.range_count(1_001, 1_000) == 2 and windows.range_count(10**9, 1_000) == windows.MOST_RANGES
    monkeypatch.setattr(windows, "MOST_RANGES", 3)
    cuts, stored = [], windows.written
    monkeypatch.setattr(windows, "written", lambda df, name: cuts.append(df.rdd.getNumPartitions()) or stored(df, name))
    df = skewed(spark)
    got = {r["id"]: r["rn"] for r in windows.ranked_rows(df, ["g"], ["v", "id"], rows_per_bucket=5).collect()}
    plain = df.withColumn("rn", F.row_number().over(W.partitionBy("g").orderBy("v", "id")))
    assert got == {r["id"]: r["rn"] for r in plain.collect()} and cuts[0] <= 3


@pytest.mark.parametrize("bucket", [1_000_000, 20])
@pytest.mark.parametrize("groups", [["g"], []])
def test_ranked_rows_equals_plain_window(spark, bucket, groups):
    df = skewed(spark)
    got = windows.ranked_rows(df, groups, ["v", "id"], rows_per_bucket=bucket)
    plain = df.withColumn("rn", F.row_number().over(W.partitionBy(*(groups or [F.lit(0)])).orderBy("v", "id")).cast("long"))
    assert got.columns == df.columns + ["rn"]
    assert sorted(got.collect(), key=lambda r: r["id"]) == sorted(plain.collect(), key=lambda r: r["id"])


def test_a_thousand_ranges(spark):
    df = spark.range(3_000).select("id", F.lit("g").alias("g"), (F.col("id") * 7919 % 3_001).alias("v"))
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", 3)
    try:
        got = windows.ranked_rows(df, ["g"], ["v", "id"], rows_per_bucket=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.rangeExchange.sampleSizePerPartition")
    assert [r["rn"] for r in sorted(got, key=lambda r: (r["v"], r["id"]))] == list(range(1, 3_001))


def test_balanced_sample_counts(spark):
    """Label sizes 1 x 10, 15 x 5, 2 x 4, 1 x 3 with ids shared across labels."""
    sizes = [10] + [5] * 15 + [4, 4] + [3]
    rows, n = [], 0
    for label, size in enumerate(sizes):
        for _ in range(size):
            rows.append((n % 62, n, f"L{label:02d}"))
            n += 1
    df = spark.createDataFrame(rows, "claim_id long, row_id long, label string")
    four = sampling.balanced_exact_n(df, "label", ["claim_id", "row_id"], 4)
    five = sampling.balanced_exact_n(df, "label", ["claim_id", "row_id"], 5)
    assert (df.count(), four.count(), five.count()) == (96, 72, 80)
    assert {r["count"] for r in four.groupBy("label").count().collect()} == {4}
    rest = joins.anti_keys(df, four, "claim_id")
    used = {r["claim_id"] for r in four.collect()}
    assert rest.count() == sum(1 for c, _, _ in rows if c not in used)


def test_oversampling_repeats_only_rare_classes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "c"), (6, "c"), (7, None)], "id long, label string")
    got = {(r["label"], r["count"]) for r in sampling.oversample_rare(df, "label").groupBy("label").count().collect()}
    assert got == {("a", 3), ("b", 3), ("c", 2)}


def test_small_classes_grow_to_the_largest_and_no_further(spark):
    rows = [(i, "big", i) for i in range(7)] + [(10, "two", 1), (11, "two", 2), (12, "one", 1), (13, None, 1)]
    df = spark.createDataFrame(rows, "id long, label string, copies long")
    found = sampling.oversample_rare(df, "label", 2).collect()
    by_label, by_row = Counter(r["label"] for r in found), Counter(r["id"] for r in found)
    assert by_label == {"big": 7, "two": 7, "one": 7}
    assert (by_row[10], by_row[11], by_row[12]) == (4, 3, 7)
    assert sorted(r["copy"] for r in found if r["id"] == 10) == [1, 2, 3, 4]


def test_many_copies_are_made_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPIES_PER_TASK_ROW", 7)
    df = spark.createDataFrame([(1,), (2,)], "id long")
    got = sampling.repeat_rows(df, 23)
    assert got.count() == 46
    assert sorted(r["copy"] for r in got.filter("id = 1").collect()) == list(range(1, 24))


def test_stratified_split_is_disjoint_complete_and_sized(spark):
    df = skewed(spark).filter("g is not null")
    parted = sampling.split_stratified(df, "g", "id", 0.2)
    assert parted.count() == df.count()
    sizes = {r["g"]: (r["n"], r["t"]) for r in parted.groupBy("g").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()}
    assert all(t == -(-n * 2 // 10) for n, t in sizes.values())


def test_random_split_does_not_depend_on_partitioning(spark):
    df = spark.range(500)
    one = {r["id"] for r in sampling.split_random(df.repartition(2), "id", 0.8).filter("is_train = 1").collect()}
    two = {r["id"] for r in sampling.split_random(df.repartition(7), "id", 0.8).filter("is_train = 1").collect()}
    assert one == two and 350 < len(one) < 450


def test_singletons_and_rest_cover_all(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, label string")
    rare, rest = sampling.rare_and_rest(df, "label")
    assert [r["id"] for r in rare.collect()] == [3]
    assert sorted(r["id"] for r in rest.collect()) == [1, 2]


def test_anti_join_drops_null_keys_and_lookup_keeps_all_labels(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "k long")
    assert [r["k"] for r in joins.anti_keys(df, spark.createDataFrame([(1,)], "k long"), "k").collect()] == [3]
    hits = spark.createDataFrame([(9, 1, 1)], "query_id long, claim_id long, rank int")
    claims = spark.createDataFrame([(1, "A"), (1, "B"), (1, "A")], "claim_id long, label string")
    assert sorted(r["label"] for r in joins.lookup_labels(hits, claims, "claim_id", "label").collect()) == ["A", "B"]


def test_text_join_keeps_the_best_rank(spark):
    hits = spark.createDataFrame([(1, 10, "x"), (1, 11, "x"), (1, 12, "y")], "query_id long, claim_id long, chunk string")
    ranked = spark.createDataFrame([(1, "x", 2), (1, "x", 5), (1, "y", 1)], "query_id long, chunk string, rank int")
    got = {(r["claim_id"], r["rank"]) for r in joins.hits_by_text(ranked, hits, "chunk").collect()}
    assert got == {(10, 2), (11, 2), (12, 1)}


def test_frequency_index_breaks_ties_alphabetically(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    got = {r["value"]: r["value_index"] for r in features.frequency_index(df, "v").collect()}
    assert got == {"c": 0, "a": 1, "b": 2}


def test_join_beyond_the_broadcast_bound_gives_the_same(spark, monkeypatch):
    from claimlens import session

    df = skewed(spark)
    counts = {(r["id"], r["cnt"]) for r in joins.with_group_counts(df, ["g"]).collect()}
    monkeypatch.setattr(joins, "small_side", lambda d: session.small_side(d, rows=1))
    assert counts == {(r["id"], r["cnt"]) for r in joins.with_group_counts(df, ["g"]).collect()}


def test_onehot_refuses_too_many_values(spark):
    with pytest.raises(ValueError):
        features.onehot_values(spark.range(50), "id", most=10)
