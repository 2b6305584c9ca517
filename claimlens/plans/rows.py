"""Projections, predicates, scalar functions and nested documents over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions import cleanse, documents, text
from claimlens.plans.registry import query
from claimlens.plans.tables import SHORT_FIELDS
from claimlens.plans.views import CLAIMS, DIRTY, claims, dirty_claims, plain_claims, table, tokens_sql
from claimlens.session import spread


@query("proj_select", f"WITH {CLAIMS} SELECT claim_id, engine, failcode, miles FROM claims")
def proj_select(spark, sf):
    return plain_claims(spark, sf).select("claim_id", "engine", "failcode", "miles")


@query("proj_rename", "SELECT doc_id AS claim_id, md5(text) AS document, lang AS label FROM documents")
def proj_rename(spark, sf):
    chosen = table(spark, sf, "documents").select("doc_id", "text", "lang")
    renamed = chosen.withColumnsRenamed({"doc_id": "claim_id", "text": "document", "lang": "label"})
    return renamed.withColumn("document", F.md5("document"))


@query("proj_drop", f"WITH {CLAIMS} SELECT engine, failcode, miles, coalesce(label, 'none') AS label FROM claims")
def proj_drop(spark, sf):
    dropped = claims(spark, sf).drop("claim_id", "narrative", "NO SUCH COLUMN")
    return dropped.withColumn("label", F.coalesce("label", F.lit("none")))


@query(
    "filter_null_or_numeric",
    f"WITH {DIRTY} SELECT claim_id, coalesce(code, 'none') AS code FROM dirty WHERE code IS NULL OR TRY_CAST(code AS DOUBLE) IS NOT NULL",
)
def filter_null_or_numeric(spark, sf):
    kept = cleanse.keep_null_or_numeric(dirty_claims(spark, sf), ["code"])
    return kept.select("claim_id", F.coalesce("code", F.lit("none")).alias("code"))


@query(
    "filter_labelled",
    f"WITH {DIRTY}, n AS (SELECT claim_id, coalesce(label, 'Not Inspected') AS label FROM dirty) SELECT * FROM n WHERE label <> 'Not Inspected'",
)
def filter_labelled(spark, sf):
    rows = dirty_claims(spark, sf).select("claim_id", cleanse.null_label_to_sentinel("label").alias("label"))
    return cleanse.labelled(rows, "label")


@query(
    "filter_unlabelled",
    f"""WITH {DIRTY}, n AS (SELECT claim_id, engine, CASE WHEN label IS NULL OR TRY_CAST(label AS DOUBLE) IS NOT NULL
          OR regexp_matches(label, '^\\d+$|\\|') THEN 'Not Inspected' ELSE label END AS label FROM dirty)
        SELECT * FROM n WHERE label = 'Not Inspected'""",
)
def filter_unlabelled(spark, sf):
    rows = dirty_claims(spark, sf).select("claim_id", "engine", cleanse.normalize_label("label").alias("label"))
    return cleanse.unlabelled(rows, "label")


@query(
    "filter_conjunctive",
    "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 450 AND NOT starts_with(text, 'Th')",
)
def filter_conjunctive(spark, sf):
    d = table(spark, sf, "documents")
    kept = d.filter(F.col("lang") == "en").filter(F.col("n_chars") > 450).filter(~F.col("text").startswith("Th"))
    return kept.select("doc_id", "source", "n_chars")


@query(
    "filter_label_denylist",
    f"WITH {CLAIMS} SELECT claim_id, label FROM claims WHERE label NOT IN ('Q0_T0', 'Q0_T1')",
)
def filter_label_denylist(spark, sf):
    return cleanse.drop_labels(claims(spark, sf), "label", ["Q0_T0", "Q0_T1"]).select("claim_id", "label")


@query("filter_key_lookup", "SELECT event_id, user_id, event_type, value FROM events WHERE user_id = 42")
def filter_key_lookup(spark, sf):
    return cleanse.rows_of_key(table(spark, sf, "events"), "user_id", 42).select("event_id", "user_id", "event_type", "value")


@query(
    "filter_substring_pick",
    "SELECT doc_id, source, md5(text) AS text_md5 FROM documents WHERE starts_with(text, 'Th') ORDER BY doc_id LIMIT 1",
)
def filter_substring_pick(spark, sf):
    first = cleanse.first_with_prefix(table(spark, sf, "documents"), "text", "Th", "doc_id")
    return first.select("doc_id", "source", F.md5("text").alias("text_md5"))


# --- scalar functions -------------------------------------------------------------------


@query("clean_label_null", f"WITH {DIRTY} SELECT claim_id, coalesce(label, 'Not Inspected') AS label FROM dirty")
def clean_label_null(spark, sf):
    return dirty_claims(spark, sf).select("claim_id", cleanse.null_label_to_sentinel("label").alias("label"))


@query(
    "clean_label_numeric",
    f"""WITH {DIRTY} SELECT claim_id, coalesce(CASE WHEN TRY_CAST(label AS DOUBLE) IS NOT NULL THEN 'Not Inspected'
        ELSE label END, 'none') AS label FROM dirty""",
)
def clean_label_numeric(spark, sf):
    return dirty_claims(spark, sf).select(
        "claim_id", F.coalesce(cleanse.numeric_label_to_sentinel("label"), F.lit("none")).alias("label")
    )


@query(
    "clean_label_regex",
    f"""WITH {DIRTY} SELECT claim_id, coalesce(CASE WHEN regexp_matches(label, '^\\d+$|\\|') THEN 'Not Inspected'
        ELSE label END, 'none') AS label FROM dirty""",
)
def clean_label_regex(spark, sf):
    return dirty_claims(spark, sf).select(
        "claim_id", F.coalesce(cleanse.pattern_label_to_sentinel("label"), F.lit("none")).alias("label")
    )


@query("cast_numeric", f"WITH {DIRTY} SELECT claim_id, coalesce(TRY_CAST(code AS DOUBLE), -1) AS code FROM dirty")
def cast_numeric(spark, sf):
    cast = cleanse.cast_numeric(dirty_claims(spark, sf).select("claim_id", "code"), ["code"])
    return cast.select("claim_id", F.coalesce("code", F.lit(-1.0)).alias("code"))


@query(
    "fill_missing",
    f"WITH {DIRTY} SELECT claim_id, coalesce(TRY_CAST(code AS DOUBLE), 0) AS \"FC\", coalesce(label, 'none') AS label FROM dirty",
)
def fill_missing(spark, sf):
    rows = dirty_claims(spark, sf).select("claim_id", F.col("code").alias("FC"), "label")
    filled = cleanse.fill_missing(cleanse.cast_numeric(rows, ["FC"]))
    return filled.withColumn("label", F.coalesce("label", F.lit("none")))  # string NULLs were left alone


@query(
    "clean_text",
    r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n', '', 'g'), ' ?\.', '.', 'g') AS t FROM documents)
        SELECT doc_id, md5(t) AS text_md5, length(t) AS text_length FROM c""",
)
def clean_text(spark, sf):
    cleaned = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", text.clean_text("text").alias("t"))
    return cleaned.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("text_length"))


CODES = """concat_ws(',', nullif(l_linenumber, 1)::VARCHAR, CASE WHEN l_tax > 0.04 THEN l_suppkey END::VARCHAR,
  nullif(l_linenumber, 3)::VARCHAR, CASE WHEN l_discount > 0.05 THEN l_partkey END::VARCHAR, CAST(NULL AS VARCHAR))"""


@query("concat_codes", f"SELECT l_orderkey, l_linenumber, l_partkey, {CODES} AS fc FROM lineitem")
def concat_codes(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.nullif("l_linenumber", F.lit(1)).alias("FC_1"),
        F.when(F.col("l_tax") > 0.04, F.col("l_suppkey")).alias("FC_2"),
        F.nullif("l_linenumber", F.lit(3)).alias("FC_3"),
        F.when(F.col("l_discount") > 0.05, F.col("l_partkey")).alias("FC_4"),
        F.lit(None).cast("string").alias("FC_5"),
    )
    fc = text.concat_codes(["FC_1", "FC_2", "FC_3", "FC_4", "FC_5"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", fc.alias("fc"))


@query("lowercase_text", "SELECT doc_id, md5(lower(text)) AS text_md5 FROM documents")
def lowercase_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.lower("text")).alias("text_md5"))


@query(
    "template_text",
    """SELECT doc_id, md5(concat('What failed here? ', text, ' Answer:')) AS text_md5,
              length(concat('What failed here? ', text, ' Answer:')) AS text_length FROM documents""",
)
def template_text(spark, sf):
    filled = text.template_text("What failed here? ", "text", " Answer:")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(filled).alias("text_md5"), F.length(filled).cast("long").alias("text_length")
    )


@query(
    "struct_to_text",
    f"WITH {CLAIMS} SELECT claim_id, md5(concat_ws(' ', engine, failcode, miles::VARCHAR, label, narrative)) AS text_md5 FROM claims",
)
def struct_to_text(spark, sf):
    rows = documents.with_document(claims(spark, sf), ["engine", "failcode", "miles", "label", "narrative"])
    return rows.select("claim_id", F.md5(text.struct_to_text(rows, "DOCUMENT")).alias("text_md5"))


@query("json_fields", "SELECT event_id, json_extract_string(lower(upper(props)), '$.k')::BIGINT AS k FROM events")
def json_fields(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.upper("props").alias("props"))
    return text.json_fields(rows, "props", T.StructType([T.StructField("k", T.LongType())])).drop("props")


@query(
    "records_to_json",
    "SELECT json_object('event_id', event_id, 'user_id', user_id, 'event_type', event_type)::VARCHAR AS record FROM events",
)
def records_to_json(spark, sf):
    return text.records_to_json(table(spark, sf, "events").select("event_id", "user_id", "event_type"))


@query(
    "probability_percent",
    """WITH p AS (SELECT event_id, concat('[', (value / 1000)::VARCHAR, ']') AS s FROM events),
            v AS (SELECT event_id, TRY_CAST(substr(s, 2, length(s) - 2) AS DOUBLE) * 100 AS pct FROM p)
       SELECT event_id, round(pct, 6) AS percent, floor(pct)::BIGINT AS shown FROM v""",
)
def probability_percent(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("["), (F.col("value") / 1000).cast("string"), F.lit("]")).alias("probability")
    )
    percent = text.probability_percent("probability")
    return rows.select("event_id", F.round(percent, 6).alias("percent"), F.floor(percent).cast("long").alias("shown"))


@query(
    "softmax_probability",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings),
            x AS (SELECT vec_id, a, list_transform(a, lambda v: exp(v - list_max(a))) AS ex FROM e)
       SELECT vec_id, (list_position(a, list_max(a)) - 1)::BIGINT AS prediction,
              round(list_max(ex) / list_sum(ex), 6) AS probability, len(a)::BIGINT AS classes FROM x""",
)
def softmax_probability(spark, sf):
    scored = table(spark, sf, "embeddings").select("vec_id", text.softmax_argmax("embedding").alias("s"))
    return scored.select(
        "vec_id",
        F.col("s.prediction").cast("long").alias("prediction"),
        F.round("s.probability", 6).alias("probability"),
        F.size("s.probabilities").cast("long").alias("classes"),
    )


@query(
    "rerank_dot_score",
    """SELECT vec_id, trunc(list_inner_product(list_transform(embedding, lambda x: x::DOUBLE * 10),
              list_transform(list_reverse(embedding), lambda x: x::DOUBLE * 10)))::BIGINT AS score FROM embeddings""",
)
def rerank_dot_score(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 10)
    rows = table(spark, sf, "embeddings").select("vec_id", scaled.alias("a"))
    return rows.select("vec_id", text.rerank_dot_score(F.col("a"), F.reverse("a")).cast("long").alias("score"))


# --- nested documents -------------------------------------------------------------------


@query(
    "struct_build",
    f"""WITH {CLAIMS} SELECT claim_id, engine, failcode, miles, coalesce(label, 'none') AS label, 4 AS n_fields FROM claims""",
)
def struct_build(spark, sf):
    rows = documents.with_document(claims(spark, sf), ["engine", "failcode", "miles"], label="label")
    count = len(rows.schema["DOCUMENT"].dataType.fieldNames())
    flat = rows.select("claim_id", "DOCUMENT.*", F.lit(count).alias("n_fields"))
    return flat.withColumn("label", F.coalesce("label", F.lit("none")))


@query("struct_fields", f"WITH {CLAIMS} SELECT claim_id, failcode, miles FROM claims")
def struct_fields(spark, sf):
    rows = documents.with_document(plain_claims(spark, sf), [f for f in SHORT_FIELDS if f != "label"]).select("claim_id", "DOCUMENT")
    return documents.struct_fields(rows, ["failcode", "miles", "no_such_field"])


@query(
    "array_from_fields",
    f"""WITH {CLAIMS} SELECT claim_id, 4::BIGINT AS n, concat_ws('|', engine, failcode, miles::VARCHAR, coalesce(label, 'none')) AS joined FROM claims""",
)
def array_from_fields(spark, sf):
    rows = documents.with_document(claims(spark, sf), SHORT_FIELDS)
    made = rows.select("claim_id", documents.array_from_fields(rows, SHORT_FIELDS).alias("a"))
    return made.select("claim_id", F.size("a").cast("long").alias("n"), F.array_join("a", "|", "none").alias("joined"))


@query(
    "explode_chunks",
    f"""WITH {CLAIMS}, c AS (
          SELECT claim_id, 0 AS chunk_pos, engine AS chunk FROM claims UNION ALL SELECT claim_id, 1, failcode FROM claims
          UNION ALL SELECT claim_id, 2, miles::VARCHAR FROM claims UNION ALL SELECT claim_id, 3, label FROM claims)
        SELECT claim_id, chunk_pos, coalesce(chunk, 'none') AS chunk FROM c""",
)
def explode_chunks(spark, sf):
    rows = documents.with_document(claims(spark, sf), SHORT_FIELDS)
    chunks = documents.claim_chunks(rows, SHORT_FIELDS, ["claim_id"])
    return chunks.withColumn("chunk", F.coalesce("chunk", F.lit("none")))


WINDOWS_SQL = f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 20, 1), 80)) AS s FROM t),
c AS (SELECT doc_id, s // 80 AS chunk_pos, list_slice(w, s + 1, s + 100) AS w FROM p)
SELECT doc_id, chunk_pos::BIGINT AS chunk_pos, len(w)::BIGINT AS n_tokens, md5(array_to_string(w, ' ')) AS chunk_md5 FROM c"""


def chunk_digest(chunks):
    return chunks.select(
        "doc_id",
        F.col("chunk_pos").cast("long").alias("chunk_pos"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.md5("chunk").alias("chunk_md5"),
    )


@query("chunk_tokens", WINDOWS_SQL)
def chunk_tokens(spark, sf):
    texts = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return chunk_digest(documents.chunk_tokens(texts, "text", ["doc_id"], 100, 20))


@query("udf_pandas_iterator", WINDOWS_SQL)
def udf_pandas_iterator(spark, sf):
    texts = spread(table(spark, sf, "documents").select("doc_id", "text"))
    chunks = texts.select("doc_id", F.posexplode(documents.token_window_udf(100, 20)("text")).alias("chunk_pos", "chunk"))
    return chunk_digest(chunks.withColumn("n_tokens", F.size(text.tokens(F.col("chunk")))))


@query(
    "chunk_sentences",
    f"""WITH RECURSIVE s AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+')) AS sentence,
         generate_subscripts(regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+'), 1) AS sno FROM documents),
t AS (SELECT doc_id, sno, {tokens_sql('sentence')} AS w FROM s),
c AS (SELECT doc_id, sno, w, unnest(range(0, len(w), 100)) AS f FROM t),
pieces AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sno, f) AS i, list_slice(w, f + 1, f + 100) AS w FROM c),
sized AS (SELECT doc_id, i, len(w) AS n, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM pieces),
-- for each piece as a first one: the last piece that still fits
ends AS (
  SELECT a.doc_id, a.i AS first, max(b.i) AS last
  FROM sized a JOIN sized b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i <= a.i + 100 AND b.upto - (a.upto - a.n) <= 100
  GROUP BY ALL),
-- and the piece the next run starts with
steps AS (
  SELECT e.doc_id, e.first, e.last, min(b.i) AS next
  FROM ends e JOIN sized l ON l.doc_id = e.doc_id AND l.i = e.last
       JOIN sized m ON m.doc_id = e.doc_id AND m.i = e.last + 1
       JOIN sized b ON b.doc_id = e.doc_id AND b.i > e.first AND b.i <= e.last + 1
            AND l.upto - (b.upto - b.n) <= 20 AND m.upto - (b.upto - b.n) <= 100
  GROUP BY ALL),
runs(doc_id, pos, first, last) AS (
  SELECT doc_id, 0, first, last FROM ends WHERE first = 1
  UNION ALL
  SELECT r.doc_id, r.pos + 1, e.first, e.last FROM runs r
  JOIN steps s ON s.doc_id = r.doc_id AND s.first = r.first
  JOIN ends e ON e.doc_id = s.doc_id AND e.first = s.next)
SELECT r.doc_id, r.pos::BIGINT AS chunk_pos, sum(len(p.w))::BIGINT AS n_tokens,
       md5(string_agg(array_to_string(p.w, ' '), ' ' ORDER BY p.i)) AS chunk_md5
FROM runs r JOIN pieces p ON p.doc_id = r.doc_id AND p.i BETWEEN r.first AND r.last
GROUP BY r.doc_id, r.pos""",
)
def chunk_sentences(spark, sf):
    texts = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return chunk_digest(documents.chunk_sentences(texts, "text", ["doc_id"], 100, 20))


@query(
    "assemble_claim_vector",
    """WITH p AS (SELECT vec_id // 4 AS claim_id, vec_id % 4 AS pos, embedding::DOUBLE[] AS e FROM embeddings),
            v AS (SELECT claim_id, flatten(list(e ORDER BY pos)) AS a FROM p WHERE pos <> 3 GROUP BY claim_id)
       SELECT claim_id, len(a)::BIGINT AS size, round(list_sum(a), 6) AS total, round(a[1], 6) AS first_value,
              round(a[-1], 6) AS last_value FROM v""",
)
def assemble_claim_vector(spark, sf):
    chunks = table(spark, sf, "embeddings").select(
        F.expr("vec_id div 4").alias("claim_id"), (F.col("vec_id") % 4).alias("chunk_pos"), "embedding"
    )
    made = documents.assemble_claim_vector(chunks, ["claim_id"], "chunk_pos", "embedding", skip=[3])
    a = F.col("embedding").cast("array<double>")
    return made.select(
        "claim_id",
        F.size("embedding").cast("long").alias("size"),
        F.round(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x), 6).alias("total"),
        F.round(F.element_at(a, 1), 6).alias("first_value"),
        F.round(F.element_at(a, -1), 6).alias("last_value"),
    )


@query(
    "truncate_tokens",
    f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)
        SELECT doc_id, md5(array_to_string(list_slice(w, 1, 512), ' ')) AS text_md5, (len(w) > 512)::INT AS truncated FROM t""",
)
def truncate_tokens(spark, sf):
    cut, was_cut = text.truncate_tokens("text", 512)
    texts = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return texts.select("doc_id", F.md5(cut).alias("text_md5"), was_cut.cast("int").alias("truncated"))
