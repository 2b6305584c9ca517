import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlens.functions import cleanse, documents, text
from claimlens.operators import embedding

WORDS = lambda n: " ".join(f"w{i}" for i in range(n))


@pytest.mark.parametrize(
    "n,sizes", [(0, [0]), (1, [1]), (100, [100]), (101, [100, 21]), (180, [100, 100]), (181, [100, 100, 21]), (513, [100] * 6 + [33])]
)
def test_token_windows(spark, n, sizes):
    df = spark.createDataFrame([(1, WORDS(n))], "id long, t string")
    rows = documents.chunk_tokens(df, "t", ["id"]).orderBy("chunk_pos").collect()
    assert [r["n_tokens"] for r in rows] == sizes
    assert [r["chunk"].split(" ")[0] for r in rows] == [f"w{80 * i}" if n else "" for i in range(len(sizes))]
    udf = df.select(documents.token_window_udf()("t")).first()[0]
    assert udf == [r["chunk"] for r in rows]


def test_null_text_has_no_chunks(spark):
    df = spark.createDataFrame([(1, None)], "id long, t string")
    assert documents.chunk_tokens(df, "t", ["id"]).count() == 0
    assert documents.chunk_sentences(df, "t", ["id"]).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40), st.integers(12, 30), st.integers(0, 11))
def test_packed_runs(lengths, size, overlap):
    runs = documents.pack_lengths(np.array(lengths, dtype="int64"), size, overlap)
    covered = [i for r in runs for i in range(r["first"], r["last"] + 1)]
    assert sorted(set(covered)) == list(range(len(lengths)))
    for r in runs:
        assert sum(lengths[r["first"] : r["last"] + 1]) <= size
    for a, b in zip(runs, runs[1:]):
        assert b["first"] > a["first"] and b["last"] > a["last"]
        assert sum(lengths[b["first"] : a["last"] + 1]) <= overlap


def test_sentences_keep_every_token(spark):
    raw = "...One two. Three?! " + WORDS(250) + " end. Tail without stop"
    df = spark.createDataFrame([(1, raw)], "id long, t string")
    rows = documents.chunk_sentences(df, "t", ["id"], 100, 0).orderBy("chunk_pos").collect()
    assert " ".join(r["chunk"] for r in rows).split() == raw.replace("...One", "... One").split()
    assert all(r["n_tokens"] <= 100 for r in rows)


def test_document_without_label_and_null_fields(spark):
    df = spark.createDataFrame([(1, "a", None, "L")], "id long, x string, y string, label string")
    bare = documents.with_document(df, ["x", "y"])
    full = documents.with_document(df, ["x", "y"], label="label")
    assert bare.schema["DOCUMENT"].dataType.fieldNames() == ["x", "y"]
    assert full.schema["DOCUMENT"].dataType.fieldNames() == ["x", "y", "label"]
    assert [r["chunk"] for r in documents.claim_chunks(bare, ["x", "y"], ["id"]).collect()] == ["a", None]
    assert full.select(text.struct_to_text(full, "DOCUMENT")).first()[0] == "a L"
    assert documents.struct_fields(bare.select("id", "DOCUMENT"), ["y", "absent"]).columns == ["id", "y"]


def test_claim_vector_skips_the_label_position_in_every_copy(spark):
    rows = [(c, copy, p, [float(p)]) for c in (1,) for copy in (0, 1) for p in range(9)]
    df = spark.createDataFrame(rows, "claim long, copy int, p int, e array<float>").repartition(4)
    got = documents.assemble_claim_vector(df, ["claim", "copy"], "p", "e", skip=[7]).collect()
    assert [r["embedding"] for r in got] == [[0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0]] * 2


def test_cleaning(spark):
    df = spark.createDataFrame(
        [(1, None, "12"), (2, "7", None), (3, "A|B", "x1"), (4, "Leak", "3.5"), (5, "", "")], "id long, label string, code string"
    )
    labels = [r[0] for r in df.orderBy("id").select(cleanse.normalize_label("label")).collect()]
    assert labels == ["Not Inspected"] * 3 + ["Leak", ""]
    step = df.orderBy("id").withColumn("label", cleanse.null_label_to_sentinel("label"))
    step = step.withColumn("label", cleanse.numeric_label_to_sentinel("label")).withColumn("label", cleanse.pattern_label_to_sentinel("label"))
    assert [r["label"] for r in step.collect()] == labels
    assert sorted(r["id"] for r in cleanse.keep_null_or_numeric(df, ["code"]).collect()) == [1, 2, 4]
    assert sorted(r["id"] for r in cleanse.labelled(df, "label").collect()) == [2, 3, 4, 5]
    assert sorted(r["id"] for r in cleanse.drop_labels(df, "label", ["7"]).collect()) == [3, 4, 5]


def test_long_denylist_joins_instead(spark, monkeypatch):
    monkeypatch.setattr(cleanse, "LITERAL_LIST_LIMIT", 1)
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "label string")
    assert [r[0] for r in cleanse.drop_labels(df, "label", ["a", "b"]).collect()] == ["c"]
    assert cleanse.drop_labels(df, "label", ["a", None]).count() == cleanse.drop_labels(df, "label", [None]).count() == 0


def test_clean_text_and_codes(spark):
    df = spark.createDataFrame([("Leak .\nFixed.", None, None), (None, "1", None)], "t string, a string, b string")
    assert [r[0] for r in df.select(text.clean_text("t")).collect()] == ["Leak.Fixed.", None]
    assert [r[0] for r in df.select(text.concat_codes(["a", "b"])).collect()] == ["", "1"]


def test_probability_and_softmax(spark):
    df = spark.createDataFrame([("[0.81]", [1.0, 3.0, 3.0]), ("bad", [1000.0, 0.0, 0.0])], "p string, l array<double>")
    assert [r[0] for r in df.select(text.probability_percent("p")).collect()] == [81.0, None]
    got = [r[0] for r in df.select(text.softmax_argmax("l")).collect()]
    assert [g["prediction"] for g in got] == [1, 0]
    assert abs(sum(got[0]["probabilities"]) - 1) < 1e-12 and got[1]["probability"] == 1.0


def test_truncation_flag(spark):
    df = spark.createDataFrame([(WORDS(512),), (WORDS(513),)], "t string")
    cut, flag = text.truncate_tokens("t", 512)
    rows = df.select(cut.alias("c"), flag.alias("f")).collect()
    assert [(len(r["c"].split()), r["f"]) for r in rows] == [(512, False), (512, True)]


def test_both_embedders_agree_and_are_unit_length(spark):
    df = spark.createDataFrame([(1, "Pump leaks\tPUMP"), (2, ""), (3, "ünï çode \n x"), (4, None)], "id long, t string")
    a = {r["id"]: r["e"] for r in df.select("id", embedding.embed_text(F.col("t"), 32, "double").alias("e")).collect()}
    b = {r["id"]: r["embedding"] for r in embedding.embed_hashed(df.filter("t is not null"), "t", 32, element="double").collect()}
    assert a[4] is None and a[2] == [0.0] * 32
    for i in (1, 2, 3):
        assert np.allclose(a[i], b[i])
    assert abs(np.linalg.norm(a[1]) - 1) < 1e-12


def test_failed_batch_gives_nulls_and_keeps_rows(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise embedding.EmbeddingFailed("too long")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 3 else "x" * i) for i in range(1, 9)], "id long, t string").coalesce(1)
    got = [r["e"] for r in df.select("id", embedding.embed_batched(F.col("t"), model, batch=4).alias("e")).orderBy("id").collect()]
    assert got == [None] * 4 + [[5.0], [6.0], [7.0], [8.0]]
    calls = df.select(embedding.embed_batched_iterator(F.col("t"), lambda: model, batch=4).alias("e")).collect()
    assert len(calls) == 8


def test_hashed_vectors_of_a_slice_are_those_of_each_text(spark, monkeypatch):
    odd = ["", "  ", " a", "b ", "\ta\n\nb\r c", "a\x0bb c", "x\x0cy", " z q", "é ü 漢字 " * 30, *("w" * n for n in (54, 55, 56, 200)), "\x1c q 　r"]
    odd += [" ".join(f"w{i * j % 97}" for j in range(i)) for i in range(80)]
    for dimensions in (16, 64, 1024):
        model = embedding.HashedEmbedder(dimensions)
        assert np.array_equal(np.array(model(odd)), model.matrix(pa.array(odd)))
        assert np.array_equal(np.array(model(odd[:5])), model.matrix(pa.array(odd[:5])))
    monkeypatch.setattr(embedding, "SLICE_TEXTS", 3)
    texts = pa.array([None, *odd, None, None, None, "end", None])
    found = embedding.hashed_arrays(texts.slice(1), model, pa.float64()).to_pylist()
    assert found == [None if t is None else model([t])[0].tolist() for t in texts.slice(1).to_pylist()]
    # No text is embedded as a Python object.
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    one = embedding.HashedEmbedder(16)
    one._one = None
    assert df.where(F.size(embedding.embed_batched(F.col("t"), one, element="double")) == 16).count() == len(odd)
