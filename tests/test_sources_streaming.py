import pytest
from pyspark.sql import functions as F

from claimlens.functions.documents import claim_chunks, with_document
from claimlens.functions.text import concat_codes
from claimlens.plans import tables
from claimlens.plans.tables import CLAIM_FIELDS, chunk_batch
from claimlens.plans.views import claims_of, table
from claimlens.session import scratch_path, shared_dir
from claimlens.sources import readers, sinks
from claimlens.streaming.ingest import batch_writer, drain


def test_csv_is_all_strings_with_normalised_names(spark, tmp_path):
    path = str(tmp_path / "claims.csv")
    rows = spark.createDataFrame([("1", "a", 'say "no", twice'), ("x", "", None)], ["FC 1", "Failure Mode Bucket", "note"])
    sinks.write_csv(rows, path)
    back = readers.read_claims_csv(spark, path)
    assert back.columns == ["FC_1", "FAILURE_MODE_BUCKET", "NOTE"]
    assert {t for _, t in back.dtypes} == {"string"}
    assert sorted(r["NOTE"] or "" for r in back.collect()) == ["", 'say "no", twice']
    assert readers.normalise_columns(spark.createDataFrame([], "`FC 1` string")).columns == ["FC_1"]


def test_raw_file_to_documents_and_chunks(spark, tmp_path):
    """The chain from a raw file: all columns as strings, codes joined, document with its label in place, chunks without it."""
    path, raw = str(tmp_path / "raw.csv"), readers.RAW_CLAIM_COLUMNS
    values = {"CLAIM_ID_SEQ": "17", "FC 1": "a1", "FC 3": "c3", "FAILCODE": "f", "Failure Mode Bucket": "Leak", "DEALER": "d"}
    sinks.write_csv(spark.createDataFrame([tuple(values.get(c) for c in raw)], ", ".join(f"`{c}` string" for c in raw)), path)
    rows = readers.read_claims_csv(spark, path, raw)
    assert rows.columns == [readers.normalise_name(c) for c in raw]
    ready = rows.withColumn("FC", concat_codes([f"FC_{n}" for n in range(1, 6)])).withColumn("CLEANED_CORRECTION", F.lit("Replaced seal."))
    typed = ready.select(F.col("CLAIM_ID_SEQ").cast("long"), *readers.DOCUMENT_FIELDS)
    nested = with_document(typed, readers.DOCUMENT_FIELDS)
    assert [f.name for f in nested.schema] == readers.CLAIM_SCHEMA.names
    assert nested.schema["DOCUMENT"].dataType.names == readers.CLAIM_SCHEMA["DOCUMENT"].dataType.names
    chunks = {r["chunk_pos"]: r["chunk"] for r in claim_chunks(nested, readers.DOCUMENT_FIELDS, ["CLAIM_ID_SEQ"]).collect()}
    assert chunks[3] == "a1,c3" and chunks[readers.LABEL_POSITION] == "Leak" and chunks[8] == "Replaced seal." and len(chunks) == 9
    blind = [f for n, f in enumerate(readers.DOCUMENT_FIELDS) if n != readers.LABEL_POSITION]
    assert "Leak" not in [r["chunk"] for r in claim_chunks(with_document(typed, blind), blind, ["CLAIM_ID_SEQ"]).collect()]


def test_table_is_created_once(spark):
    name = "made_" + scratch_path(spark, "x").split("/")[-2]
    path = scratch_path(spark, name)
    assert sinks.create_table_if_absent(spark, name, lambda: spark.range(3), path)
    assert not sinks.create_table_if_absent(spark, name, lambda: spark.range(9), path)
    assert readers.scan_table(spark, name).count() == 3


def test_shared_folder_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_stream_equals_batch(spark, sf):
    target, checkpoint = scratch_path(spark, "t"), scratch_path(spark, "c")
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    stream = readers.stream_table(spark, sf, documents.schema, glob="documents.parquet")
    drain(stream, target, checkpoint, chunk_batch(labels))
    batch = claim_chunks(with_document(claims_of(documents, labels), CLAIM_FIELDS), CLAIM_FIELDS, ["claim_id"])
    got = spark.read.parquet(target).drop("query", "batch_id")
    assert got.count() == batch.count() > 0
    assert got.exceptAll(batch).count() == 0


@pytest.mark.parametrize("files", [1, 3])
def test_stream_of_a_table_that_is_a_folder(spark, tmp_path, files):
    rows = [(i, f"text {i}", "en", "s", 6 + i) for i in range(9)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counts = tables.stream_available_now(spark, str(tmp_path)).first()
    assert (counts["cnt"], counts["chars"], counts["batches"]) == (9, sum(r[4] for r in rows), 1)
    assert {r["doc_id"] for r in tables.src_stream_table(spark, str(tmp_path)).collect()} == set(range(9))
    for found in (tables.stream_explode_chunks, tables.stream_foreach_batch_append):
        assert found(spark, str(tmp_path)).count() == 45
    assert {r["query_id"] for r in tables.search_chunks(spark, str(tmp_path)).collect()} == set(range(9))


def test_replayed_batch_replaces_itself(spark):
    target = scratch_path(spark, "t")
    write = batch_writer(target, lambda b: b.withColumn("twice", F.col("id") * 2))
    write(spark.range(3), 0)
    write(spark.range(3, 5), 1)
    write(spark.range(3), 0)
    assert sorted(r["twice"] for r in spark.read.parquet(target).collect()) == [0, 2, 4, 6, 8]


def test_second_drain_takes_only_new_files(spark):
    source, target, checkpoint = (scratch_path(spark, n) for n in "stc")
    for start in (0, 10):
        spark.range(start, start + 10).coalesce(1).write.mode("append").parquet(source)
        drain(readers.stream_table(spark, source, spark.range(1).schema), target, checkpoint)
    drain(readers.stream_table(spark, source, spark.range(1).schema), target, checkpoint)
    batches = {r["batch_id"]: r["count"] for r in spark.read.parquet(target).groupBy("batch_id").count().collect()}
    assert batches == {0: 10, 1: 10}


def test_a_new_checkpoint_adds_to_an_old_target(spark):
    target = scratch_path(spark, "t")
    for start, n in ((0, 10), (10, 3)):
        source, checkpoint = scratch_path(spark, "s"), scratch_path(spark, "c")
        spark.range(start, start + n).write.parquet(source)
        drain(readers.stream_table(spark, source, spark.range(1).schema), target, checkpoint)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == list(range(13))


def test_tables_of_queries_leave_the_catalog(spark, sf):
    from claimlens.plans.catalog import QUERIES

    before = {t.name for t in spark.catalog.listTables()}
    for key in ("src_table_scan", "sink_append_table", "sink_overwrite_table", "sink_ctas_if_absent"):
        assert QUERIES[key](spark, sf).count() > 0
    assert {t.name for t in spark.catalog.listTables()} == before
