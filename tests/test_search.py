import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.operators import search


def vectors_of(spark, matrix, first_id=0):
    rows = [(first_id + i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "claim_id long, embedding array<float>").repartition(3)


def brute(queries, vectors, k, exclude_self):
    q, v = np.asarray(queries, dtype="float32").astype(float), np.asarray(vectors, dtype="float32").astype(float)
    scores = np.round(q @ v.T, search.SCORE_PLACES)
    found = set()
    for i, row in enumerate(scores):
        order = sorted((-s, j) for j, s in enumerate(row) if not (exclude_self and i == j))[:k]
        found |= {(i, j, r + 1) for r, (_, j) in enumerate(order)}
    return found


def triples(hits):
    return {(r["query_id"], r["claim_id"], r["rank"]) for r in hits.select("query_id", "claim_id", "rank").collect()}


def as_queries(df):
    return df.withColumnRenamed("claim_id", "query_id")


def clustered(rng, centres, per, width=8, noise=0.05):
    middle = rng.standard_normal((centres, width))
    points = np.repeat(middle, per, axis=0) + noise * rng.standard_normal((centres * per, width))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


PLANS = [(10_000, 65_536), (0, 65_536), (0, 20)]  # scan, grid, reachable block pairs


@pytest.fixture(autouse=True)
def always_prune(monkeypatch):
    monkeypatch.setattr(search, "WORTHWHILE_SHARE", 1.0)


@pytest.mark.parametrize("scan_queries,unpruned_rows", PLANS)
def test_topk_equals_brute_force(spark, scan_queries, unpruned_rows):
    data = clustered(np.random.default_rng(1), 12, 25)
    df = vectors_of(spark, data)
    hits = search.topk(as_queries(df), df, 5, scan_queries=scan_queries, unpruned_rows=unpruned_rows)
    assert triples(hits) == brute(data, data, 5, True)


@pytest.mark.parametrize("scan_queries,unpruned_rows", PLANS)
def test_topk_not_unit_length_and_queries_apart(spark, scan_queries, unpruned_rows):
    rng = np.random.default_rng(2)
    data, asked = rng.standard_normal((200, 6)) * rng.uniform(0.1, 5, (200, 1)), rng.standard_normal((17, 6)) * 3
    hits = search.topk(as_queries(vectors_of(spark, asked)), vectors_of(spark, data), 4, exclude_self=False, scan_queries=scan_queries, unpruned_rows=unpruned_rows)
    assert triples(hits) == brute(asked, data, 4, False)


@pytest.mark.parametrize("scan_queries,unpruned_rows", PLANS)
def test_topk_with_a_third_of_all_rows_equal(spark, scan_queries, unpruned_rows):
    data = clustered(np.random.default_rng(3), 10, 15)
    data[::3] = data[0]
    df = vectors_of(spark, data)
    hits = search.topk(as_queries(df), df, 6, scan_queries=scan_queries, unpruned_rows=unpruned_rows)
    assert triples(hits) == brute(data, data, 6, True)


def test_topk_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 7)
    data = clustered(np.random.default_rng(4), 6, 20)
    df = vectors_of(spark, data)
    assert triples(search.topk(as_queries(df), df, 3, scan_queries=0, unpruned_rows=30)) == brute(data, data, 3, True)


def test_topk_fewer_vectors_than_k(spark):
    data = np.eye(4)
    df = vectors_of(spark, data)
    assert triples(search.topk(as_queries(df), df, 10)) == brute(data, data, 10, True)


@pytest.mark.parametrize("seed_rows", [2, 40])
def test_scan_with_a_floor_from_a_few_vectors(spark, monkeypatch, seed_rows):
    monkeypatch.setattr(search, "SEED_FROM", 10)
    monkeypatch.setattr(search, "SEED_ROWS", seed_rows)
    monkeypatch.setattr(search, "SCORES_AT_ONCE", 2_000)
    data = clustered(np.random.default_rng(10), 10, 15)
    data[::3] = data[0]
    df = vectors_of(spark, data)
    assert triples(search.topk(as_queries(df), df, 5)) == brute(data, data, 5, True)


@pytest.mark.parametrize("floored", [False, True])
def test_many_equal_vectors_in_one_block(floored):
    vectors = np.vstack([np.ones((1000, 2)), [[3, 3]], np.ones((500, 2))])
    queries = np.array([[1.0, 1.0], [2.0, 0.0]])
    floor = np.full(2, 0.5) if floored else None
    rows, columns, values = search.best_pairs(queries, vectors, 3, floor)
    assert columns.tolist() == [1000, 0, 1] * 2
    assert rows.tolist() == [0, 0, 0, 1, 1, 1] and values.tolist() == [6.0, 2.0, 2.0, 6.0, 2.0, 2.0]


def test_no_queries_and_no_vectors(spark):
    df = vectors_of(spark, np.eye(3))
    assert search.topk(as_queries(df.filter("claim_id < 0")), df, 2).count() == 0
    assert search.topk(as_queries(df), df.filter("claim_id < 0"), 2).count() == 0


def test_ties_take_the_lower_id(spark):
    df = vectors_of(spark, [[1, 0]] * 5)
    hits = search.topk(as_queries(df), df, 2)
    assert triples(hits) == {(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 2), (2, 0, 1), (2, 1, 2), (3, 0, 1), (3, 1, 2), (4, 0, 1), (4, 1, 2)}


def test_pruning_skips_cells(spark):
    """Well apart clusters: most cells are never visited."""
    middle = np.eye(8) * 10
    data = np.repeat(middle, 30, axis=0) + 0.01 * np.random.default_rng(5).standard_normal((240, 8))
    pivots, radius = middle, np.full(8, 0.1)
    sc = spark.sparkContext
    reach = search._reachable(sc.broadcast(pivots), sc.broadcast(radius), 3).func
    import pandas as pd

    q, v = data[:5], data[5:30]
    cells = reach(pd.Series([5]), pd.Series([q.ravel()]), pd.Series([25]), pd.Series([v.ravel()]))
    assert list(cells[0]) == [0]


def test_overlapping_cells_are_not_worth_pruning():
    rng = np.random.default_rng(8)
    apart, mixed = np.eye(8) * 10, rng.standard_normal((40, 8))
    assert search.visited_share(np.vstack([apart, apart + 0.01]), np.full(16, 0.1), np.full(16, 5.0)) < 0.2
    assert search.visited_share(mixed, np.full(40, 3.0), np.full(40, 5.0)) > 0.5


def test_text_ids_and_small_scan_steps(spark, monkeypatch):
    monkeypatch.setattr(search, "SCORES_AT_ONCE", 50)
    data = clustered(np.random.default_rng(9), 4, 10)
    df = vectors_of(spark, data).withColumn("claim_id", F.format_string("c%03d", "claim_id"))
    hits = search.topk(as_queries(df), df, 4)
    got = {(int(q[1:]), int(c[1:]), r) for q, c, r in triples(hits)}
    assert got == brute(data, data, 4, True)


def test_filter_comes_before_search(spark):
    data = clustered(np.random.default_rng(6), 4, 10)
    df = vectors_of(spark, data)
    hits = search.topk_filtered(as_queries(df), df, F.col("claim_id") >= 20, 3)
    assert min(r["claim_id"] for r in hits.collect()) >= 20
    assert hits.count() == 40 * 3


@pytest.mark.parametrize("query_bytes,vector_rows", [(64 * 8 * 16, 40), (10**9, 25), (400, 10**6)])
def test_grid_of_many_parts(spark, monkeypatch, query_bytes, vector_rows):
    monkeypatch.setattr(search, "GRID_BYTES", query_bytes)
    monkeypatch.setattr(search, "GRID_VECTORS", vector_rows)
    data = clustered(np.random.default_rng(11), 8, 20)
    data[::3] = data[0]
    df = vectors_of(spark, data)
    shape = search.grid_shape(160, 160, 8, 4)
    assert shape[0] * shape[1] >= 4 and shape[0] >= 160 * 64 // query_bytes
    assert triples(search.topk(as_queries(df), df, 4, scan_queries=0)) == brute(data, data, 4, True)


def test_grid_copies_are_bounded():
    for rows in (10**5, 10**7, 10**9):
        q_parts, v_parts = search.grid_shape(rows // 10, rows, 64, 1000)
        assert q_parts <= rows // 10 * 512 // search.GRID_BYTES + 1 and v_parts <= max(1000, rows // search.GRID_VECTORS + 1)


def test_grid_with_no_rows_on_a_side(spark):
    df = vectors_of(spark, np.eye(3))
    assert search.topk(as_queries(df.filter("claim_id < 0")), df, 2, scan_queries=0).count() == 0
    assert search.topk(as_queries(df), df.filter("claim_id < 0"), 2, scan_queries=0).count() == 0


def test_unequal_vectors_are_an_error(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0]), (2, [1.0, 2.0])], "claim_id long, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="unequal length"):
        search.topk(as_queries(df), df, 2).collect()


def test_lsh_recall_and_share_of_pairs(spark):
    data = clustered(np.random.default_rng(7), 40, 25, width=16)
    df = vectors_of(spark, data)
    pairs = lambda found: {(q, c) for q, c, _ in found}
    exact = triples(search.topk(as_queries(df), df, 5))
    near = triples(search.topk_lsh(as_queries(df), df, 5, rows_per_bucket=16))
    assert len(pairs(exact) & pairs(near)) / len(exact) >= 0.9
    assert len(near) == len(pairs(near))
    bits = search.bucket_bits(1000, 16)
    planes = search.plane_signs(16, 4, bits, 7)
    own = (np.round(data @ planes, 9).reshape(1000, 4, bits) > 0) @ (1 << np.arange(bits))
    met = sum((np.bincount(own[:, band]) ** 2).sum() for band in range(4))
    assert met < 0.2 * 1000**2


def test_lsh_parts_of_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(search, "GRID_BYTES", 8 * 8 * 30)
    monkeypatch.setattr(search, "GRID_VECTORS", 25)
    data = clustered(np.random.default_rng(12), 1, 200, noise=0.3)
    df = vectors_of(spark, data)
    found = triples(search.topk_lsh(as_queries(df), df, 3, bands=2, probes=1, rows_per_bucket=100))
    planes = search.plane_signs(8, 2, 1, 7)
    own = np.round(data.astype("float32").astype(float) @ planes, 9) > 0
    assert len(found) == 600 and own.shape == (200, 2)
    assert found == brute(data, data, 3, True)  # with one bit, one probe visits every bucket


def features(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, feature array<long>")


def test_rerank_is_a_permutation_and_keeps_order_of_ties(spark):
    hits = spark.createDataFrame([(1, 10, 1, "a"), (1, 11, 2, "b"), (1, 12, 3, "c"), (2, 10, 1, "d"), (3, 13, 1, "e")], "query_id long, claim_id long, rank int, s string")
    queries = features(spark, [(1, [1, 2, 3]), (2, None)], "query_id")
    claims = features(spark, [(10, [1]), (11, [1, 2, 9]), (12, [3])], "claim_id")
    found = search.rerank(hits, queries, claims, search.overlap_scores)
    got = [tuple(r[c] for c in ("query_id", "claim_id", "rank", "first_rank", "rerank_score", "s")) for r in found.orderBy("query_id", "rank").collect()]
    assert got == [(1, 11, 1, 2, 2.0, "b"), (1, 10, 2, 1, 1.0, "a"), (1, 12, 3, 3, 1.0, "c"), (2, 10, 1, 1, 0.0, "d"), (3, 13, 1, 1, 0.0, "e")]


def test_rerank_by_any_scorer(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, claim_id long, rank int")
    found = search.rerank(hits, features(spark, [(1, [5])], "query_id"), features(spark, [(10, [1]), (11, [7])], "claim_id"), lambda q, hs: F.transform(hs, lambda h: (h[0] + q[0]).cast("double")))
    assert [(r["claim_id"], r["rerank_score"]) for r in found.orderBy("rank").collect()] == [(11, 12.0), (10, 6.0)]


def test_cosine_of_term_weights(spark):
    from collections import Counter
    from math import log, sqrt

    texts = {1: "Pump leak leak", 2: "pump LEAK", 3: "wire burnt", 4: "", 5: None, 6: "leak"}
    df = spark.createDataFrame(list(texts.items()), "id long, t string").repartition(3)
    weights = search.term_weights(df, "id", "t", "feature")
    assert {r["id"] for r in weights.collect()} == {1, 2, 3, 6}
    terms = {k: Counter((t or "").lower().split()) for k, t in texts.items()}
    frequency = Counter(w for t in terms.values() for w in t)
    vector = {k: {w: n * (log(7 / (1 + frequency[w])) + 1) for w, n in t.items()} for k, t in terms.items()}
    length = {k: sqrt(sum(w * w for w in v.values())) or 1 for k, v in vector.items()}
    hits = spark.createDataFrame([(q, c, n + 1) for q in texts for n, c in enumerate(x for x in texts if x != q)], "query_id long, claim_id long, rank int")
    found = search.rerank(hits, weights.withColumnRenamed("id", "query_id"), weights.withColumnRenamed("id", "claim_id")).collect()
    assert len(found) == 30
    for r in found:
        a, b = vector[r["query_id"]], vector[r["claim_id"]]
        wanted = sum(a[w] * b[w] for w in a.keys() & b.keys()) / length[r["query_id"]] / length[r["claim_id"]]
        assert abs(r["rerank_score"] - wanted) < 1e-8


@pytest.mark.parametrize("frequent", [0, 3, 100])
def test_coded_sets_lose_nothing(spark, monkeypatch, frequent):
    rng = np.random.default_rng(14)
    sets = {i: sorted(set(rng.integers(0, 40, 12).tolist())) for i in range(20)} | {20: [], 21: None}
    df = spark.createDataFrame(list(sets.items()), "id long, s array<long>").repartition(3)
    counts = df.select(F.explode("s").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    monkeypatch.setattr(search, "FREQUENT", max(1, frequent))
    listed = search.frequent_terms(counts)[0][:frequent]
    coded = df.select("id", search.coded_set(F.col("s"), spark.sparkContext.broadcast(listed)).alias("feature"))
    hits = spark.createDataFrame([(q, c, n + 1) for q in sets for n, c in enumerate(x for x in sets if x != q)], "query_id long, claim_id long, rank int")
    found = search.rerank(hits, coded.withColumnRenamed("id", "query_id"), coded.withColumnRenamed("id", "claim_id"), search.coded_overlap_scores)
    assert all(r["rerank_score"] == len(set(sets[r["query_id"]] or ()) & set(sets[r["claim_id"]] or ())) for r in found.collect())


def test_coded_sets_are_small():
    """What moves ten times a claim: a frequent word takes about a byte, not the eight of its hash."""
    listed = np.random.default_rng(15).integers(-(2**62), 2**62, 5_000)
    row, _ = search.TermCoder(listed)(np.unique(listed[::10]))
    assert len(row[1]) + len(row[2]) < 2 * 500 and search.set_codes(*row[:2]).tolist() == list(range(0, 5_000, 10))
    counts = np.array([1, 127, 128, 70_000, 0, 2**40])
    assert search.unpacked_numbers(search.packed_numbers(counts), 6).tolist() == counts.tolist()


def test_term_weights_with_few_listed_terms_and_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(search, "FREQUENT", 2)
    rows = [(1, "a b b c"), (1, "c d"), (2, "b c e e"), (3, "a f"), (None, "a b")]
    weights = search.term_weights(spark.createDataFrame(rows, "id long, t string").repartition(3), "id", "t", "feature")
    counts, frequency = {1: {"a": 1, "b": 2, "c": 2, "d": 1}, 2: {"b": 1, "c": 1, "e": 2}, 3: {"a": 1, "f": 1}}, {"a": 3, "b": 3, "c": 2, "d": 1, "e": 1, "f": 1}
    vector = {k: {w: n * (np.log(6 / (1 + frequency[w])) + 1) for w, n in t.items()} for k, t in counts.items()}
    hits = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2)], "query_id long, claim_id long, rank int")
    claims = weights.select(F.col("id").alias("claim_id"), search.hit_weights(F.col("feature")).alias("feature"))
    length = {k: np.sqrt(sum(w * w for w in v.values())) for k, v in vector.items()}
    for r in search.rerank(hits, weights.withColumnRenamed("id", "query_id"), claims).collect():
        q, c = r["query_id"], r["claim_id"]
        assert abs(r["rerank_score"] - sum(vector[q][w] * vector[c][w] for w in vector[q].keys() & vector[c].keys()) / length[q] / length[c]) < 2e-9


@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e20])
def test_running_best_in_blocks(monkeypatch, scale):
    """Products in single precision only choose; what is kept has the scores of double precision."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(16)
    queries, vectors = rng.standard_normal((20, 6)) * scale, rng.standard_normal((900, 6))
    vectors[300:600] = vectors[0] * (1 + 1e-9 * np.arange(300)[:, None])
    best = search.RunningBest(queries, 4)
    for start in (0, 100, 500):
        stop = {0: 100, 100: 500, 500: 900}[start]
        best.add(np.arange(start, stop), vectors[start:stop])
    assert best.merge()
    kept = best.batch(search.pa.array(range(20)), search.pa.int64()).to_pydict()
    scores = np.round(queries @ vectors.T, search.SCORE_PLACES)
    wanted = [(q, int(c)) for q in range(20) for c in np.lexsort((np.arange(900), -scores[q]))[:4]]
    assert list(zip(kept["query_id"], kept["claim_id"])) == wanted or scale != 1.0
    assert np.allclose(kept["score"], [scores[q, c] for q, c in wanted], rtol=1e-12)


def test_blocks_that_would_meet_too_many_others_go_to_the_grid(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 4)
    df = vectors_of(spark, clustered(np.random.default_rng(17), 3, 200))
    q, v = search._sides(as_queries(df), df, "query_id", "embedding", "claim_id", "embedding")
    assert search._reachable_pairs(q, v, 600, 600, 4, 4) is None
    assert triples(search.topk(as_queries(df), df, 3, scan_queries=0, unpruned_rows=20)) == triples(search.topk(as_queries(df), df, 3))


def test_surrogate_ids_are_distinct_and_stable(spark):
    rows = spark.createDataFrame([("1", 0), ("1", 1), ("2", 0), (None, 0), ("", 0)], "c string, p int")
    ids = [r[0] for r in rows.select(search.surrogate_id("c", "p")).collect()]
    assert len(set(ids)) == 5
    assert sorted(ids) == sorted(r[0] for r in rows.repartition(3).select(search.surrogate_id("c", "p")).collect())


def test_rerank_reads_a_batch_where_it_lies(monkeypatch):
    """A batch of queries with their hits' weights takes no multiple of its size: its rows are read one at a time."""
    import tracemalloc

    monkeypatch.setattr(search, "FREQUENT", 4_000)
    pa, rng = search.pa, np.random.default_rng(24)
    coder = search.TermCoder(rng.permutation(4_000) - 2_000)
    texts = []
    for _ in range(50):
        row, order = coder(rng.choice(5_000, 1_500, replace=False) - 2_500)
        counts, idf = rng.integers(1, 300, 1_500), rng.random(1_500) + 1
        texts.append((*row, search.packed_numbers(counts), float(np.sqrt(((counts * idf) ** 2).sum())), idf.tobytes()))
    asked, hits = [n % 50 if n % 7 else None for n in range(300)], [[(n * 3 + i) % 50 if i else None for i in range(10)] for n in range(300)]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.binary())
    query = [pa.array([None if q is None else texts[q][c] for q in asked], kind) for c, kind in enumerate(kinds)]
    others = [pa.array([[None if h is None else texts[h][c] for h in row] for row in hits], pa.list_(kind)) for c, kind in enumerate(kinds[:5])]
    size = sum(x.nbytes for x in query + others)
    tracemalloc.start()
    found = search.cosine_rows([x.slice(2) for x in query], [x.slice(2) for x in others]).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 10_000_000 and peak < size / 20
    dense, rare = np.zeros((2, 50, 6_000)), np.unique(np.concatenate([np.frombuffer(x[2], np.int64) for x in texts]))
    for t, (m, codes, rest, n, length, idf) in enumerate(texts):
        at = np.r_[search.set_codes(m, codes), np.searchsorted(rare, np.frombuffer(rest, np.int64)) + 4_000]
        count = search.unpacked_numbers(n, 1_500)
        dense[0, t, at], dense[1, t, at] = count * np.frombuffer(idf) / length * np.frombuffer(idf), count / length
    for q, row, scores in zip(asked[2:], hits[2:], found):
        assert np.allclose(scores, [0 if q is None or h is None else dense[0, q] @ dense[1, h] for h in row], atol=2e-9)


def test_shared_numbers_and_merged_hits():
    rng = np.random.default_rng(5)
    for n, m in ((0, 3), (3, 0), (1, 1), (40, 60), (500, 20)):
        x, y = (np.unique(rng.integers(-50, 50, s)) for s in (n, m))
        assert search.shared_numbers(x, y) == len(np.intersect1d(x, y))
    # Ids may be numbers or strings; equal scores keep the lower id.
    rows, values = np.array([0, 0, 0, 1, 1]), np.array([0.5, 0.5, 0.9, 0.1, 0.1])
    for kind in (np.int64, str):
        ids = np.array([7, 3, 5, 9, 8]).astype(kind)
        got = search.lowest_first(rows, ids, values, 2)
        assert got[0].tolist() == [0, 0, 1, 1] and got[1].tolist() == np.array([5, 3, 8, 9]).astype(kind).tolist() and got[2].tolist() == [0.9, 0.5, 0.1, 0.1]
