import math
import random
import statistics

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.operators import aggregates, classify, evaluate, predict


@pytest.fixture(scope="module")
def judged(spark):
    hits = spark.createDataFrame(
        [(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1), (2, 21, 2), (2, 22, 3)], "query_id long, claim_id long, rank int"
    )
    targets = spark.createDataFrame([(1, 10), (1, 12), (2, 99), (2, 21), (2, 21)], "query_id long, claim_id long")
    return evaluate.judged_hits(hits, targets), evaluate.target_sizes(targets)


def test_recall_grows_with_k(judged):
    got = {r["k"]: r["recall"] for r in evaluate.recall_at_k(*judged, range(1, 4)).collect()}
    assert got == {1: 0.25, 2: 0.5, 3: 0.75}


def test_precision_and_ndcg(judged):
    got = {r["k"]: r for r in evaluate.retriever_measures(*judged, range(1, 4)).collect()}
    assert got[3]["precision"] == pytest.approx(0.5)
    ideal = 1 + 1 / math.log2(3)
    first, second = (1 + 1 / math.log2(4)) / ideal, (1 / math.log2(3)) / ideal
    assert got[3]["ndcg"] == pytest.approx((first + second) / 2)


def test_distance_is_zero_for_the_same_set_and_one_for_disjoint_sets(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    b = spark.createDataFrame([("z",)], "c string")
    assert evaluate.distribution_distance(a, a, ["c"]).first()["distance"] == 0
    assert evaluate.distribution_distance(a, b, ["c"]).first()["distance"] == pytest.approx(1)


def test_accuracy_counts_missing_predictions(spark):
    df = spark.createDataFrame([("a", "a"), ("b", None), ("c", "d"), ("e", "e")], "actual string, predicted string")
    assert df.agg(aggregates.accuracy_percent("actual", "predicted")).first()[0] == 50.0


def test_majority_prefers_count_then_rank_then_label(spark):
    rows = [(1, "b", 1), (1, "a", 2), (1, "a", 3), (2, "z", 1), (2, "y", 2), (3, "n", 1), (3, "m", 1)]
    hits = spark.createDataFrame(rows, "query_id long, label string, rank int")
    got = {r["query_id"]: r["label"] for r in aggregates.majority_label(hits).collect()}
    assert got == {1: "a", 2: "z", 3: "m"}


@pytest.mark.parametrize("width", [3, 13])
def test_correlation_matrix(spark, width):
    """NULLs leave their pairs alone and a constant column gives NaN, whatever the number of columns."""
    rnd = random.Random(width)
    columns = [[rnd.choice([None, 1.0, 2.0, 5.0, float(i)]) for i in range(40)] for _ in range(width - 2)] + [[7.0] * 40, [None] * 40]
    names = [f"c{i}" for i in range(width)]
    df = spark.createDataFrame(list(zip(*columns)), ", ".join(f"{n} double" for n in names))
    found = {(r["i"], r["j"]): r["r"] for r in aggregates.correlation_matrix(df, names).collect()}
    assert len(found) == width * width
    for (i, j), r in found.items():
        both = [(a, b) for a, b in zip(columns[i], columns[j]) if a is not None and b is not None]
        if not both:
            assert r is None
        elif width - 2 in (i, j):
            assert math.isnan(r)
        else:
            assert r == pytest.approx(statistics.correlation(*map(list, zip(*both))))


def test_correlation_of_many_columns_is_one_scan(spark):
    rng = np.random.default_rng(4)
    data = rng.standard_normal((300, 100)) + 1e6 * np.arange(100)
    data[:, 7] = 0.1
    gaps = rng.random((300, 100)) < 0.2
    gaps[:, 11] = True
    rows = [[None if g else float(v) for v, g in zip(*r)] for r in zip(data, gaps)]
    names = [f"v{i}" for i in range(100)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = {(r["i"], r["j"]): r["r"] for r in aggregates.correlation_matrix(df.mapInArrow(counted, df.schema), names).collect()}
    assert len(found) == 10_000 and seen.value == 300
    for i, j in [(0, 1), (5, 90), (99, 3), (20, 20)]:
        both = ~(gaps[:, i] | gaps[:, j])
        assert found[i, j] == pytest.approx(np.corrcoef(data[both, i], data[both, j])[0, 1], abs=1e-9)
    assert found[7, 3] != found[7, 3] and found[7, 7] != found[7, 7] and found[11, 3] is None and found[3, 11] is None


def test_correlation_of_a_column_that_is_constant_where_both_are_there(spark):
    rows = [(1.1, 5.0), (1.1, 7.0), (1.1, 6.0), (3.3, None), (2.2, None)] * 7
    df = spark.createDataFrame(rows, "a double, b double").repartition(3)
    found = {(r["i"], r["j"]): r["r"] for r in aggregates.correlation_matrix(df, ["a", "b"]).collect()}
    assert found[0, 0] == 1.0 and found[0, 1] != found[0, 1] and found[1, 1] == 1.0


def test_onehot_correlation_follows_the_matrix_where_nothing_varies(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, None)], "c string, k double, v double")
    got = {(r["value"], r["feature"]): r["r"] for r in aggregates.onehot_correlation(df, "c", ["k", "v"]).collect()}
    assert got["a", "k"] != got["a", "k"] and got["a", "v"] != got["a", "v"] and got["b", "v"] is None


def test_correlation_pairs(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), float(-i)) for i in range(30)], "a double, b double, c double")
    names = ["a", "b", "c"]
    pairs = aggregates.correlation_pairs(aggregates.correlation_matrix(df, names), names)
    assert {(r["feature_a"], r["feature_b"]) for r in pairs.collect()} == {("b", "a"), ("c", "a"), ("c", "b")}


def test_a_query_without_hits_counts(spark):
    judged = spark.createDataFrame([(1, 1, 1), (1, 2, 0)], "query_id long, rank int, relevant int")
    sizes = spark.createDataFrame([(1, 1), (2, 3)], "query_id long, n_targets long")
    assert [r["recall"] for r in evaluate.recall_at_k(judged, sizes, [2]).collect()] == [0.5]
    found = evaluate.retriever_measures(judged, sizes, [2]).first()
    assert (found["precision"], found["recall"], found["ndcg"]) == (0.25, 0.5, 0.5)


def test_weights_of_nothing_give_null(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, 3.0)], "g string, v double, w double")
    found = {r["g"]: r["m"] for r in df.groupBy("g").agg(aggregates.weighted_mean("v", "w").alias("m")).collect()}
    assert found == {"a": None, "b": 2.0}


def test_onehot_correlation_equals_corr(spark):
    rows = [("x", 1.0), ("x", 2.0), ("y", 5.0), ("z", 0.0), ("y", 3.0), ("x", None), ("y", None), ("z", 4.0)]
    df = spark.createDataFrame(rows, "c string, v double")
    got = {r["value"]: r["r"] for r in aggregates.onehot_correlation(df, "c", ["v"]).collect()}
    for value in "xyz":
        assert got[value] == pytest.approx(df.agg(F.corr((F.col("c") == value).cast("double"), "v")).first()[0])


def queries_and_claims(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 0.9])], "claim_id long, embedding array<float>")
    claims = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "B"), (4, None)], "claim_id long, label string")
    return vectors.withColumnRenamed("claim_id", "query_id"), vectors, claims


@pytest.mark.parametrize("pick", ["top", "majority"])
def test_prediction_gives_one_row_per_query(spark, pick):
    queries, vectors, claims = queries_and_claims(spark)
    got = {r["query_id"]: r["predicted_label"] for r in predict.predict_by_neighbours(queries, vectors, claims, k=1, pick=pick).collect()}
    assert got == {1: "A", 2: "A", 3: "B", 4: "B"}


def test_unknown_pick_is_refused(spark):
    queries, vectors, claims = queries_and_claims(spark)
    with pytest.raises(ValueError):
        predict.predict_by_neighbours(queries, vectors, claims, pick="best")


def test_fallback_keeps_every_row(spark):
    df = spark.createDataFrame([("A", 3), ("B", 900), (None, 3)], "p string, n int")
    got = [r[0] for r in df.select(predict.with_fallback("p", F.col("n") <= 512)).collect()]
    assert got == ["A", "Too Long Input", "Too Long Input"]


def test_classifiers_learn_what_is_separable(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], "odd" if i % 2 else "even", "pump leak" if i % 2 else "wire burnt") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, e array<float>, label string, t string")
    by_vector = classify.predict_embeddings(classify.fit_embedding_classifier(df, "e", "label"), df, "e", "id", "label")
    assert by_vector.filter(F.col("label") != F.col("predicted_label")).count() == 0
    counts = classify.term_counts(df, "id", "t", 64)
    found = classify.predict_texts(classify.fit_text_model(counts, df, "id", "label", 64), counts, "id")
    assert {(r["id"] % 2, r["predicted_label"]) for r in found.collect()} == {(1, "odd"), (0, "even")}
    by_mean = classify.predict_by_centroid(df, classify.centroids(df, "label", "e"), "label", "id", "e")
    assert {(r["id"] % 2, r["predicted_label"]) for r in by_mean.collect()} == {(1, "odd"), (0, "even")}


def test_text_model_equals_naive_bayes_by_hand(spark):
    from collections import Counter
    from hashlib import md5
    from math import exp, log

    texts = {1: "a b b", 2: "b c", 3: "a a a d", 4: "", 5: "zz b", 6: None, 7: "c c"}
    labels = {1: "x", 2: "y", 3: "x", 4: "z", 5: None}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "id long, t string").repartition(3)
    known = spark.createDataFrame(list(labels.items()), "id long, label string")
    counts = classify.term_counts(df, "id", "t", 32)
    got = {r["id"]: r for r in classify.predict_texts(classify.fit_text_model(counts, known, "id", "label", 32), counts, "id").collect()}
    terms = {k: Counter(int(md5(w.encode()).hexdigest()[:8], 16) % 32 for w in (t or "").split()) for k, t in texts.items()}
    of = {"x": terms[1] + terms[3], "y": terms[2], "z": terms[4]}
    prior = {"x": 2 / 4, "y": 1 / 4, "z": 1 / 4}
    assert set(got) == set(texts)
    for k, mine in terms.items():
        score = {c: log(prior[c]) + sum(n * log((of[c][t] + 1) / (of[c].total() + 32)) for t, n in mine.items()) for c in of}
        best = min(score, key=lambda c: (-round(score[c], 9), c))
        assert got[k]["predicted_label"] == best and abs(got[k]["score"] - score[best]) < 1e-9
        assert abs(got[k]["probability"] - 1 / sum(exp(s - score[best]) for s in score.values())) < 1e-9


def test_discriminant_equals_its_formula_and_takes_missing_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 4)) + np.repeat(np.eye(3, 4) * 2, 30, axis=0)
    y = np.repeat(["a", "b", "c"], 30)
    rows = [(i, v.tolist(), str(c)) for i, (v, c) in enumerate(zip(x, y))] + [(100, None, "a"), (101, [0.0] * 4, None)]
    df = spark.createDataFrame(rows, "id long, e array<double>, label string").repartition(4)
    model = classify.fit_embedding_classifier(df, "e", "label", ridge=0.05)
    got = {r["id"]: r for r in classify.predict_embeddings(model, df, "e", "id").collect()}
    means = np.array([x[y == c].mean(0) for c in "abc"])
    centred = x - means[np.searchsorted(["a", "b", "c"], y)]
    spread = centred.T @ centred / 90
    spread += np.eye(4) * (0.05 * np.trace(spread) / 4 + 1e-12)
    w = np.linalg.solve(spread, means.T)
    scores = x @ w - 0.5 * (means.T * w).sum(0) + np.log(1 / 3)
    for i in range(90):
        assert got[i]["predicted_label"] == "abc"[scores[i].argmax()] and abs(got[i]["score"] - scores[i].max()) < 1e-9
    assert got[100]["predicted_label"] is None and got[101]["predicted_label"] in "abc"
    empty = classify.fit_embedding_classifier(df.where("id < 0"), "e", "label")
    assert {r["predicted_label"] for r in classify.predict_embeddings(empty, df, "e", "id").collect()} == {None}
