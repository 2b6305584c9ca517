"""Sources, sinks and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.documents import claim_chunks, with_document
from claimlens.operators.embedding import embed_hashed
from claimlens.operators.sampling import hash_bucket
from claimlens.operators.search import surrogate_id, topk
from claimlens.plans.registry import query
from claimlens.plans.views import CLAIMS, claims_of, embedding_sql, table
from claimlens.session import scratch_path, spread
from claimlens.sources.readers import literal_rows, read_claims_csv, scan_table, stream_table
from claimlens.sources.sinks import append_table, create_table_if_absent, overwrite_table, write_csv
from claimlens.streaming.ingest import drain

CLAIM_FIELDS = ["engine", "failcode", "miles", "label", "narrative"]
SHORT_FIELDS = ["engine", "failcode", "miles", "label"]


def fresh_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


def read_and_drop(spark, name):
    """The table's rows, by its files; the catalog entry, which is external, goes at once."""
    rows = scan_table(spark, name)
    spark.sql(f"DROP TABLE {name}")
    return rows


@query(
    "src_csv_scan",
    "SELECT p_partkey, p_name, p_brand, p_type, p_size::DOUBLE AS p_size, p_retailprice FROM part",
)
def src_csv_scan(spark, sf):
    path = scratch_path(spark, "part_csv")
    parts = table(spark, sf, "part")
    write_csv(parts, path)
    raw = read_claims_csv(spark, path, parts.columns)
    return raw.select(
        F.col("P_PARTKEY").try_cast("long").alias("p_partkey"),
        F.col("P_NAME").alias("p_name"),
        F.col("P_BRAND").alias("p_brand"),
        F.col("P_TYPE").alias("p_type"),
        F.col("P_SIZE").try_cast("double").alias("p_size"),
        F.col("P_RETAILPRICE").try_cast("double").alias("p_retailprice"),
    )


@query("sink_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def sink_csv(spark, sf):
    path = scratch_path(spark, "orders_csv")
    chosen = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    write_csv(chosen, path)
    return spark.read.option("header", True).schema(chosen.schema).csv(path)


@query("src_table_scan", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def src_table_scan(spark, sf):
    name = fresh_name("parts")
    overwrite_table(table(spark, sf, "part"), name, scratch_path(spark, name))
    return read_and_drop(spark, name).select("p_partkey", "p_brand", "p_retailprice")


@query(
    "src_literal_rows",
    """SELECT d.lang AS failcode, b.title, b.weight::BIGINT AS weight, count(*) AS cnt, sum(d.n_chars)::BIGINT AS chars
       FROM documents d JOIN (VALUES ('de', 'German', 2), ('en', 'English', 1), ('es', 'Spanish', 4), ('fr', 'French', 3))
            AS b(failcode, title, weight) ON d.lang = b.failcode
       GROUP BY ALL""",
)
def src_literal_rows(spark, sf):
    schema = T.StructType(
        [
            T.StructField("failcode", T.StringType()),
            T.StructField(
                "DOCUMENT", T.StructType([T.StructField("title", T.StringType()), T.StructField("weight", T.LongType())])
            ),
        ]
    )
    rows = [("de", ("German", 2)), ("en", ("English", 1)), ("es", ("Spanish", 4)), ("fr", ("French", 3))]
    book = literal_rows(spark, rows, schema)
    counts = table(spark, sf, "documents").groupBy(F.col("lang").alias("failcode")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("n_chars").alias("chars")
    )
    return counts.join(F.broadcast(book), "failcode").select("failcode", "DOCUMENT.title", "DOCUMENT.weight", "cnt", "chars")


@query("sink_append_table", "SELECT o_orderkey, o_totalprice FROM orders")
def sink_append_table(spark, sf):
    name = fresh_name("orders")
    path = scratch_path(spark, name)
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", hash_bucket("o_orderkey").alias("b"))
    append_table(rows.filter(F.col("b") < 5000).drop("b"), name, path)
    append_table(rows.filter(F.col("b") >= 5000).drop("b"), name, path)
    return read_and_drop(spark, name)


@query("sink_overwrite_table", "SELECT o_orderkey, o_orderpriority FROM orders")
def sink_overwrite_table(spark, sf):
    name = fresh_name("orders")
    path = scratch_path(spark, name)
    orders = table(spark, sf, "orders")
    overwrite_table(orders.select("o_orderkey", "o_custkey", "o_totalprice"), name, path)
    overwrite_table(orders.select("o_orderkey", "o_orderpriority"), name, path)
    return read_and_drop(spark, name)


@query(
    "sink_ctas_if_absent",
    "SELECT o_orderkey, o_totalprice, 1 AS created_first, 0 AS created_second FROM orders",
)
def sink_ctas_if_absent(spark, sf):
    name = fresh_name("orders")
    path = scratch_path(spark, name)
    orders = table(spark, sf, "orders")
    first = create_table_if_absent(spark, name, lambda: orders.select("o_orderkey", "o_totalprice"), path)
    second = create_table_if_absent(spark, name, lambda: orders.select("o_custkey"), path)
    return read_and_drop(spark, name).withColumns(
        {"created_first": F.lit(int(first)), "created_second": F.lit(int(second))}
    )


# --- streams ----------------------------------------------------------------------------


def document_stream(spark, sf, **options):
    """The table as a stream, be it one file or a folder of files."""
    schema = table(spark, sf, "documents").schema
    return stream_table(spark, f"{sf}/documents.parquet", schema, **options)


STREAMED_DOCUMENTS = "SELECT doc_id, md5(text) AS text_md5, n_chars FROM documents"


def drained_documents(spark, sf):
    target, checkpoint = scratch_path(spark, "drained"), scratch_path(spark, "checkpoint")
    stream = document_stream(spark, sf).select("doc_id", F.md5("text").alias("text_md5"), "n_chars")
    drain(stream, target, checkpoint)
    return target, checkpoint


@query("src_stream_table", STREAMED_DOCUMENTS)
def src_stream_table(spark, sf):
    target, _ = drained_documents(spark, sf)
    return spark.read.parquet(target).select("doc_id", "text_md5", "n_chars")


@query("stream_available_now", "SELECT count(*) AS cnt, sum(n_chars)::BIGINT AS chars, 1::BIGINT AS batches FROM documents")
def stream_available_now(spark, sf):
    target, _ = drained_documents(spark, sf)
    return spark.read.parquet(target).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("n_chars").alias("chars"), F.countDistinct("batch_id").alias("batches")
    )


@query(
    "stream_checkpoint_resume",
    """WITH b AS (SELECT ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10000 AS b FROM documents)
       SELECT CASE WHEN b < 6000 THEN 0 ELSE 1 END::BIGINT AS batch_id, count(*) AS cnt FROM b GROUP BY ALL""",
)
def stream_checkpoint_resume(spark, sf):
    source, target, checkpoint = (scratch_path(spark, n) for n in ("source", "target", "checkpoint"))
    rows = table(spark, sf, "documents").select("doc_id", hash_bucket("doc_id").alias("b"))
    for part in (F.col("b") < 6000, F.col("b") >= 6000):
        rows.filter(part).write.mode("append").parquet(source)
        drain(stream_table(spark, source, rows.schema), target, checkpoint)
    drain(stream_table(spark, source, rows.schema), target, checkpoint)  # nothing new: adds no batch
    return spark.read.parquet(target).groupBy("batch_id").agg(F.count(F.lit(1)).alias("cnt"))


def chunk_batch(labels):
    """Micro-batch of documents -> chunk rows, by the functions the batch job uses."""

    def transform(batch):
        rows = with_document(claims_of(batch, labels), CLAIM_FIELDS)
        return claim_chunks(rows, CLAIM_FIELDS, ["claim_id"])

    return transform


CHUNK_DIMS = 32


def embedded_chunks(labels):
    """Micro-batch of documents -> chunk rows with a stable id and a vector: what the index holds."""
    chunked = chunk_batch(labels)

    def transform(batch):
        # A batch of few files would be embedded on few cores.
        chunks = chunked(spread(batch)).withColumn("id", surrogate_id("claim_id", "chunk_pos"))
        return embed_hashed(chunks, "chunk", CHUNK_DIMS, element="double")

    return transform


STREAM_CHUNKS = f"""WITH {CLAIMS},
chunks AS (
  SELECT claim_id, 0 AS chunk_pos, engine AS chunk FROM claims
  UNION ALL SELECT claim_id, 1, failcode FROM claims
  UNION ALL SELECT claim_id, 2, miles::VARCHAR FROM claims
  UNION ALL SELECT claim_id, 3, label FROM claims
  UNION ALL SELECT claim_id, 4, narrative FROM claims)
SELECT claim_id, chunk_pos, coalesce(md5(chunk), 'none') AS chunk_md5 FROM chunks"""


# Chunks keyed by claim and field, with the weights of their vectors.
CHUNK_VECTORS = f"""{STREAM_CHUNKS.removeprefix('WITH ').split('SELECT claim_id, chunk_pos, coalesce')[0].rstrip()},
keyed AS (SELECT claim_id * 8 + chunk_pos AS key, claim_id, chunk_pos, chunk FROM chunks),
{embedding_sql('cv', 'keyed', 'key', 'chunk', CHUNK_DIMS)}"""


def indexed_chunks(spark, sf):
    """The chunk index as the stream leaves it."""
    target, checkpoint = scratch_path(spark, "chunks"), scratch_path(spark, "checkpoint")
    drain(document_stream(spark, sf), target, checkpoint, embedded_chunks(table(spark, sf, "labels")))
    return spark.read.parquet(target)


@query(
    "stream_foreach_batch_append",
    f"""WITH {CHUNK_VECTORS}
        SELECT k.claim_id, k.chunk_pos, coalesce(md5(k.chunk), 'none') AS chunk_md5,
               ('0x' || substr(md5(concat('["', k.claim_id, '","', k.chunk_pos, '"]')), 1, 15))::BIGINT AS id,
               count(cv.dim) AS filled, round(max(cv.w), 6) AS highest
        FROM keyed k LEFT JOIN cv USING (key) GROUP BY ALL""",
)
def stream_foreach_batch_append(spark, sf):
    """Claims in, embedded chunks out, batch by batch."""
    filled = F.filter("embedding", lambda x: x != 0)
    return indexed_chunks(spark, sf).select(
        "claim_id",
        "chunk_pos",
        F.coalesce(F.md5("chunk"), F.lit("none")).alias("chunk_md5"),
        "id",
        F.coalesce(F.size(filled), F.lit(0)).cast("long").alias("filled"),
        F.round(F.array_max(filled), 6).alias("highest"),
    )


LABEL_CHUNK, TEXT_CHUNK = CLAIM_FIELDS.index("label"), CLAIM_FIELDS.index("narrative")


@query(
    "search_chunks",
    f"""WITH {CHUNK_VECTORS},
        dense AS (SELECT claim_id, chunk_pos, list_transform(range({CHUNK_DIMS}), lambda i: coalesce(map_extract_value(m, i), 0)) AS e
                  FROM (SELECT claim_id, chunk_pos, map(list(dim), list(w)) AS m FROM cv JOIN keyed USING (key) GROUP BY ALL)
                  WHERE chunk_pos <> {LABEL_CHUNK}),
        ids AS (SELECT *, ('0x' || substr(md5(concat('["', claim_id, '","', chunk_pos, '"]')), 1, 15))::BIGINT AS id FROM dense),
        hits AS (SELECT q.claim_id AS query_id, v.claim_id, v.id, round(list_inner_product(q.e, v.e), 9) AS score
                 FROM ids q, ids v WHERE q.chunk_pos = {TEXT_CHUNK} AND q.id <> v.id
                 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY score DESC, v.id) <= 10),
        folded AS (SELECT query_id, claim_id, max(score) AS score, count(*) AS chunks FROM hits GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS rank FROM folded""",
)
def search_chunks(spark, sf):
    """Each claim's text among the chunks of all fields but the label; hits fold to claims by their best chunk."""
    index = indexed_chunks(spark, sf).filter((F.col("chunk_pos") != LABEL_CHUNK) & F.exists("embedding", lambda x: x != 0))
    texts = index.filter(F.col("chunk_pos") == TEXT_CHUNK)
    hits = topk(texts, index, 10, query_id="id", vector_id="id").withColumnsRenamed({"query_id": "_query", "claim_id": "_hit"})
    owners = index.select("id", "claim_id")
    named = hits.join(owners.withColumnsRenamed({"id": "_query", "claim_id": "query_id"}), "_query").join(
        owners.withColumnRenamed("id", "_hit"), "_hit"
    )
    folded = named.groupBy("query_id", "claim_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("chunks"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "claim_id")
    return folded.withColumn("rank", F.row_number().over(order).cast("long"))


@query("stream_explode_chunks", STREAM_CHUNKS)
def stream_explode_chunks(spark, sf):
    """The stateless transform on the stream itself, outside ``foreachBatch``."""
    target, checkpoint = scratch_path(spark, "chunks"), scratch_path(spark, "checkpoint")
    stream = chunk_batch(table(spark, sf, "labels"))(document_stream(spark, sf))
    drain(stream.select("claim_id", "chunk_pos", F.coalesce(F.md5("chunk"), F.lit("none")).alias("chunk_md5")), target, checkpoint)
    return spark.read.parquet(target).drop("query", "batch_id")
