import pytest
from pyspark.sql import functions as F

from claimlens.operators import index
from claimlens.operators.index import manifest, read_index, refresh_index


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "id long, t string")


def held(spark, path):
    return sorted((r["id"], r["t"], r["e"]) for r in read_index(spark, path).collect())


def embed(seen):
    def run(new):
        seen.append(sorted(r["id"] for r in new.collect()))
        return new.withColumn("e", F.length("t"))

    return run


@pytest.mark.parametrize("compact_share", [0.0, 0.3, 10.0])
def test_index_follows_its_source(spark, tmp_path, compact_share):
    path, seen = str(tmp_path / "index"), []
    assert read_index(spark, path) is None

    def refresh(pairs, **more):
        return refresh_index(path, rows(spark, pairs), "id", embed(seen), compact_share=compact_share, **more)

    assert refresh([(1, "a"), (2, "b"), (3, None), (None, "x"), (2, "b")]) == {"added": 3, "changed": 0, "deleted": 0, "embedded": 3}
    assert held(spark, path) == [(1, "a", 1), (2, "b", 1), (3, None, None)]
    assert refresh([(1, "a"), (2, "bb"), (4, "d")]) == {"added": 1, "changed": 1, "deleted": 1, "embedded": 2}
    assert held(spark, path) == [(1, "a", 1), (2, "bb", 2), (4, "d", 1)]
    before = manifest(spark, path)
    assert refresh([(4, "d"), (2, "bb"), (1, "a")]) == {"added": 0, "changed": 0, "deleted": 0, "embedded": 0}
    assert manifest(spark, path) == before
    assert refresh([(5, "e"), (1, "aa")], deletions=False) == {"added": 1, "changed": 1, "deleted": 0, "embedded": 2}
    assert held(spark, path) == [(1, "aa", 2), (2, "bb", 2), (4, "d", 1), (5, "e", 1)]
    assert refresh([(2, "b"), (1, "aa")]) == {"added": 0, "changed": 1, "deleted": 2, "embedded": 1}
    assert held(spark, path) == [(1, "aa", 2), (2, "b", 1)]
    assert refresh([]) == {"added": 0, "changed": 0, "deleted": 2, "embedded": 0} and held(spark, path) == []
    assert refresh([(2, "b")]) == {"added": 1, "changed": 0, "deleted": 0, "embedded": 1} and held(spark, path) == [(2, "b", 1)]
    assert seen == [[1, 2, 3], [2, 4], [1, 5], [2], [2]]


def test_a_text_that_becomes_missing_is_a_change(spark, tmp_path):
    path = str(tmp_path / "index")
    refresh_index(path, rows(spark, [(1, "")]), "id")
    assert refresh_index(path, rows(spark, [(1, None)]), "id")["changed"] == 1
    assert refresh_index(path, rows(spark, [(1, None), (1, "b")]), "id")["added"] == 0


def test_a_refresh_that_breaks_off_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    refresh_index(path, rows(spark, [(1, "a")]), "id", embed([]))
    state, switch = manifest(spark, path), index._switch

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(index, "_switch", lost)
    with pytest.raises(RuntimeError):
        refresh_index(path, rows(spark, [(1, "b"), (2, "c")]), "id", embed([]))
    assert manifest(spark, path) == state and held(spark, path) == [(1, "a", 1)]
    monkeypatch.setattr(index, "_switch", switch)
    with pytest.raises(RuntimeError, match="another refresh"):
        switch(spark, path, state)
    assert refresh_index(path, rows(spark, [(1, "b"), (2, "c")]), "id", embed([]))["added"] == 1
    assert held(spark, path) == [(1, "b", 1), (2, "c", 1)]


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "index")
    refresh_index(path, rows(spark, [(1, "a"), (2, "b")]), "id", embed([]))
    old = read_index(spark, path)
    refresh_index(path, rows(spark, [(2, "bb")]), "id", embed([]), compact_share=0.0)
    assert old.count() == 2 and read_index(spark, path).count() == 1
