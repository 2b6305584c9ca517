"""The whole pipeline against each stage's own judgement on what reached it."""

import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check_queries  # noqa: E402
import corpus_pipeline  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from claimlens.llm import quality  # noqa: E402
from claimlens.llm.queries import ORACLES, QUERIES  # noqa: E402
from claimlens.session import written  # noqa: E402

from test_ngram_join import brute, shingles  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "stage")
        seen.append(docs.collect())
    return seen


def test_columns(stages):
    for rows in stages[1:-1]:
        assert rows and tuple(rows[0].asDict()) == corpus_pipeline.COLUMNS


def test_quality(spark, sf, stages):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scores = quality.quality_scores(docs, quality.train(docs, labels)).where("predicted = 1").collect()
    assert {r["doc_id"] for r in stages[1]} == {r["doc_id"] for r in scores}


def test_near_duplicates(stages):
    groups = brute([(r["doc_id"], r["text"]) for r in stages[1]], 5, 80)
    assert {r["doc_id"] for r in stages[2]} == {i for i, (_, g) in groups.items() if g == i}


def test_decontamination(spark, sf, stages):
    items = [shingles(r["text"].replace(".", "").replace(",", ""), 8) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in stages[2]:
        mine = shingles(r["text"].replace(".", "").replace(",", ""), 8)
        holds = any(i and len(i & mine) >= 0.6 * len(i) for i in items)
        assert holds == (r["doc_id"] not in {x["doc_id"] for x in stages[3]})


def test_personal_data(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    assert {r["doc_id"] for r in stages[4]} == set(before)
    for r in stages[4]:
        assert "@mail" not in r["text"] and r["n_chars"] == len(r["text"])
        if "<" not in r["text"]:
            assert r["text"] == before[r["doc_id"]]["text"]


def test_mixture(stages):
    sizes = {}
    for r in stages[4]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    taken = {}
    for r in stages[5]:
        assert 0 < r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["source_size"] == sizes[r["source"]]
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_against_sql(spark, sf, key):
    connection = duckdb.connect()
    for name in check_queries.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    state, _, _, note = check_queries.compare(spark, connection, sf, key, QUERIES[key], ORACLES[key])
    assert state == "ok", note


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
QUESTION = "Which of the seven bridges over the wide river was closed for repair in the dry summer of that year?"
PROSE = "the miller walks to town each morning and brings a sack of flour to the baker who lives behind the old church"
ODD = [
    (1, PROSE, "en", "a", 110), (2, PROSE, "en", "a", 110), (2, PROSE, "en", "a", 110), (3, None, None, None, None), (4, "", "en", "b", 0),
    (5, " \n\t", "en", None, 3), (None, PROSE, "en", "a", 110), (None, None, None, None, None), (6, "before " + QUESTION + " after", "en", "b", 120),
    (7, "write to me at some.one@mail.example.org or call " + " ".join(f"w{i}" for i in range(40)), "en", None, 1),
    (8, " ".join(f"word{i}" for i in range(30_000)), "en", "b", None), (9, "one", None, "c", 3),
]


def odd_tables(spark, folder, rows):
    extra = {c: F.lit("x") for c in ("row", "id", "key", "spans", "size", "label", "_leak", "_later", "_spans", "taken")}
    spark.createDataFrame(rows, SCHEMA).withColumns(extra).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, QUESTION), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows_pass_every_stage(spark, tmp_path):
    folder = odd_tables(spark, tmp_path / "odd", ODD)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        seen.append(sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str))
        assert tuple(docs.columns)[:5] == corpus_pipeline.COLUMNS if name != "mixture" else "taken" in docs.columns
    given = sorted(((r[0], r[1]) for r in ODD), key=str)
    assert seen[0] == given  # no label can be used
    assert seen[1] == [x for x in given if x[0] != 2]
    assert seen[2] == [x for x in seen[1] if x[0] != 6]
    assert [x[0] for x in seen[3]] == [x[0] for x in seen[2]] and "some.one" not in str(seen[3]) and (3, None) in seen[3]
    assert {x[0] for x in seen[4]} == {1, None, 7, 8, 9} and all((x[1] or "").split() for x in seen[4])
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


def test_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path / "none", [])).collect() == []
