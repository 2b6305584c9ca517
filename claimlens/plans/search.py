"""Embedding, search, prediction, classifiers and evaluation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.functions.text import tokens
from claimlens.operators import aggregates, classify, embedding, evaluate, predict, sampling, search
from claimlens.operators.index import read_index, refresh_index
from claimlens.plans.registry import query
from claimlens.plans.views import (
    CLAIMS, HITS, claims, embedding_sql, hits_sql, plain_claims, spread_claims, table, tokens_sql, vector_hits, vector_queries, vectors,
)
from claimlens.session import scratch_path, spread, written
from claimlens.plans.tables import read_and_drop
from claimlens.sources.sinks import overwrite_table

DIMS = 64

# --- embedding --------------------------------------------------------------------------

EMBEDDED = f"WITH {embedding_sql('emb', 'documents', 'doc_id', 'text', DIMS)}"
WEIGHTS = EMBEDDED + " SELECT doc_id, dim, round(w, 6) AS weight FROM (SELECT doc_id FROM documents) d LEFT JOIN emb USING (doc_id)"


def long_weights(df):
    """(doc_id, dim, weight) without the zero entries; a document without any has one row of NULLs."""
    cells = F.transform("embedding", lambda w, i: F.struct(i.cast("long").alias("dim"), F.round(w, 6).alias("weight"), w.alias("w")))
    filled = F.filter(cells, lambda c: c["w"] != 0)
    return df.select("doc_id", F.explode_outer(filled).alias("c")).select("doc_id", "c.dim", "c.weight")


def narrative(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


@query("embed_hashed", WEIGHTS)
def embed_hashed(spark, sf):
    return long_weights(embedding.embed_hashed(narrative(spark, sf), "text", DIMS, element="double"))


@query("embed_batched", WEIGHTS)
def embed_batched(spark, sf):
    made = narrative(spark, sf).withColumn("embedding", embedding.embed_text(F.col("text"), DIMS, element="double"))
    return long_weights(made)


@query(
    "udf_pandas_scalar",
    EMBEDDED + """ SELECT doc_id, count(dim) AS filled, round(max(w), 6) AS highest, round(min(w), 6) AS lowest
                   FROM (SELECT doc_id FROM documents) d LEFT JOIN emb USING (doc_id) GROUP BY doc_id""",
)
def udf_pandas_scalar(spark, sf):
    """The embedder given as any function from a list of texts to a list of vectors."""
    model = embedding.HashedEmbedder(DIMS)
    vector = embedding.embed_batched(F.lower("text"), lambda texts: model(texts), 150, element="double")
    made = narrative(spark, sf).select("doc_id", vector.alias("e"))
    filled = F.filter("e", lambda x: x != 0)
    return made.select(
        "doc_id",
        F.size(filled).cast("long").alias("filled"),
        F.round(F.array_max(filled), 6).alias("highest"),
        F.round(F.array_min(filled), 6).alias("lowest"),
    )


# --- search -----------------------------------------------------------------------------


def shown(hits):
    return hits.select("query_id", "claim_id", "score", F.col("rank").cast("long").alias("rank"))


@query("vector_topk", f"WITH {HITS} SELECT query_id, claim_id, score, rank FROM hits")
def vector_topk(spark, sf):
    return shown(vector_hits(spark, sf))


@query(
    "vector_topk_filtered",
    f"WITH {hits_sql(k=3, where='v.label < 5')} SELECT query_id, claim_id, score, rank FROM hits",
)
def vector_topk_filtered(spark, sf):
    return shown(search.topk_filtered(vector_queries(spark, sf), vectors(spark, sf), F.col("label") < 5, 3))


@query("vector_topk_grid", f"WITH {hits_sql(k=5)} SELECT query_id, claim_id, score, rank FROM hits")
def vector_topk_grid(spark, sf):
    """The plan for query sets beyond the scan bound: a grid of query parts and vector parts."""
    return shown(search.topk(vector_queries(spark, sf), vectors(spark, sf), 5, scan_queries=0))


# Small buckets, so that small tables have many; the other values are the defaults.
LSH = {"bands": 4, "probes": 2, "rows_per_bucket": 32, "seed": 7}
LSH_SQL = f"""WITH size AS (SELECT greatest(1, round(log2(count(*) / {LSH['rows_per_bucket']}::DOUBLE)))::INT AS bits FROM embeddings),
plane AS (
  SELECT band, bit, [CASE WHEN ('0x' || substr(md5(concat('{LSH['seed']}:', band, ':', bit, ':', d)), 1, 1))::BIGINT % 2 = 0
                     THEN 1::DOUBLE ELSE -1::DOUBLE END FOR d IN range(64)] AS signs
  FROM (SELECT unnest(range({LSH['bands']})) AS band) CROSS JOIN (SELECT unnest(range(bits)) AS bit FROM size)),
side AS (SELECT vec_id, band, bit, round(list_inner_product(embedding::DOUBLE[], signs), 9) AS p FROM embeddings CROSS JOIN plane),
own AS (SELECT vec_id, band, sum(CASE WHEN p > 0 THEN 1 << bit ELSE 0 END)::BIGINT AS code FROM side GROUP BY ALL),
flip AS (SELECT vec_id, band, bit FROM side QUALIFY row_number() OVER (PARTITION BY vec_id, band ORDER BY abs(p), bit) <= {LSH['probes']}),
probe AS (SELECT * FROM own UNION ALL SELECT vec_id, band, xor(code, 1 << bit) FROM own JOIN flip USING (vec_id, band)),
met AS (SELECT DISTINCT q.vec_id AS query_id, v.vec_id AS claim_id FROM probe q JOIN own v USING (band, code) WHERE q.vec_id <> v.vec_id),
hits AS (
  SELECT query_id, claim_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
  FROM met JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = claim_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS rank FROM hits QUALIFY rank <= 10"""


@query("vector_topk_lsh", LSH_SQL)
def vector_topk_lsh(spark, sf):
    return shown(search.topk_lsh(vector_queries(spark, sf), vectors(spark, sf), 10, **LSH))


RERANKED = f"""{HITS},
terms AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({tokens_sql('lower(text)')}) AS t FROM documents) GROUP BY ALL),
weighted AS (
  SELECT doc_id, t, n * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(*) OVER (PARTITION BY t))) + 1) AS w FROM terms),
unit AS (SELECT doc_id, t, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM weighted),
scored AS (
  SELECT h.query_id, h.claim_id, h.rank AS first_rank, round(coalesce(sum(a.w * b.w), 0), 9) AS s
  FROM hits h LEFT JOIN unit a ON a.doc_id = h.query_id LEFT JOIN unit b ON b.doc_id = h.claim_id AND b.t = a.t GROUP BY ALL),
reranked AS (
  SELECT query_id, claim_id, first_rank, round(s, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first_rank) AS rank FROM scored)"""


def reranked(spark, sf):
    """Vector hits re-ranked by the TF-IDF cosine of their whole texts."""
    weights = written(search.term_weights(narrative(spark, sf), "doc_id", "text", "feature"), "weights")
    found = search.rerank(
        vector_hits(spark, sf),
        weights.withColumnRenamed("doc_id", "query_id"),
        weights.select(F.col("doc_id").alias("claim_id"), search.hit_weights(F.col("feature")).alias("feature")),
    )
    return found.withColumn("cosine", F.round("rerank_score", 6))


@query("rerank_hits", f"WITH {RERANKED} SELECT query_id, claim_id, first_rank, cosine, rank FROM reranked")
def rerank_hits(spark, sf):
    ranks = [F.col(c).cast("long").alias(c) for c in ("first_rank", "rank")]
    return reranked(spark, sf).select("query_id", "claim_id", "cosine", *ranks)


@query("sort_by_rerank", f"WITH {RERANKED} SELECT query_id, claim_id, cosine FROM reranked ORDER BY cosine DESC, query_id, rank")
def sort_by_rerank(spark, sf):
    return reranked(spark, sf).orderBy(F.desc("cosine"), "query_id", "rank").select("query_id", "claim_id", "cosine")


INDEX_CALLS = """WITH b AS (SELECT doc_id, text IS NOT NULL AS there, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10000 AS b FROM documents)
SELECT 1 AS call, count_if(b < 8000) AS added, 0::BIGINT AS changed, 0::BIGINT AS deleted, count_if(b < 8000) AS embedded, count_if(b < 8000) AS held FROM b
UNION ALL SELECT 2, count_if(b >= 8000), count_if(b < 1000 AND there), 0, count_if(b >= 8000 OR (b < 1000 AND there)), count(*) FROM b
UNION ALL SELECT 3, 0, 0, count_if(b >= 5000), 0, count_if(b < 5000) FROM b
UNION ALL SELECT 4, 0, 0, 0, 0, count_if(b < 5000) FROM b"""


@query("index_refresh", INDEX_CALLS)
def index_refresh(spark, sf):
    """Four calls over a changing source: a part of the texts; all of them, some edited; half of them gone; nothing new.
    Only new and edited texts are embedded."""
    path = scratch_path(spark, "index")
    source = table(spark, sf, "documents").select("doc_id", "text").withColumn("b", sampling.hash_bucket("doc_id"))
    edited = source.withColumn("text", F.when(F.col("b") < 1000, F.concat("text", F.lit(" Edited."))).otherwise(F.col("text")))
    calls = [source.where("b < 8000"), edited, edited.where("b < 5000"), edited.where("b < 5000")]
    seen = []
    for n, rows in enumerate(calls):
        found = refresh_index(path, rows.select("doc_id", "text"), "doc_id", lambda new: embedding.embed_hashed(new, "text", DIMS))
        seen.append((n + 1, *found.values(), read_index(spark, path).count()))
    return spark.createDataFrame(seen, "call int, added long, changed long, deleted long, embedded long, held long")


@query(
    "index_content",
    f"""WITH e AS (SELECT doc_id, CASE WHEN b < 1000 THEN concat(text, ' Edited.') ELSE text END AS text
                   FROM (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10000 AS b FROM documents) WHERE b < 5000),
        {embedding_sql('emb', 'e', 'doc_id', 'text', DIMS)}
        SELECT doc_id, md5(text) AS text_md5, count(dim) AS filled, round(max(w), 6) AS highest FROM e LEFT JOIN emb USING (doc_id) GROUP BY ALL""",
)
def index_content(spark, sf):
    """What an index holds after a source was edited and half of it deleted."""
    path = scratch_path(spark, "index")
    source = table(spark, sf, "documents").select("doc_id", "text").withColumn("b", sampling.hash_bucket("doc_id"))
    edited = F.when(F.col("b") < 1000, F.concat("text", F.lit(" Edited."))).otherwise(F.col("text"))
    for rows in (source, source.withColumn("text", edited).where("b < 5000")):
        refresh_index(path, rows.select("doc_id", "text"), "doc_id", lambda new: embedding.embed_hashed(new, "text", DIMS, element="double"))
    filled = F.filter("embedding", lambda x: x != 0)
    return read_index(spark, path).select(
        "doc_id", F.md5("text").alias("text_md5"), F.size(filled).cast("long").alias("filled"), F.round(F.array_max(filled), 6).alias("highest")
    )


@query(
    "index_surrogate_id",
    f"""WITH {CLAIMS}, c AS (SELECT claim_id, unnest(range(4)) AS chunk_pos FROM claims)
        SELECT claim_id, chunk_pos::INT AS chunk_pos,
               ('0x' || substr(md5(concat('["', claim_id, '","', chunk_pos, '"]')), 1, 15))::BIGINT AS id FROM c""",
)
def index_surrogate_id(spark, sf):
    chunks = claims(spark, sf).select("claim_id", F.posexplode(F.array("engine", "failcode", "label", F.lit(""))).alias("chunk_pos", "chunk"))
    return chunks.select("claim_id", "chunk_pos", search.surrogate_id("claim_id", "chunk_pos").alias("id"))


# --- query texts ------------------------------------------------------------------------


def digest(rows):
    return rows.select("claim_id", F.md5("q").alias("text_md5"), F.length("q").cast("long").alias("text_length"))


def asked(rows, mode):
    """(claim_id, q): every claim's question, with examples from the labelled claims."""
    known = rows.filter(F.col("label").isNotNull())
    return rows.select("claim_id", predict.question(known, mode, "narrative", "label", "claim_id").alias("q"))


DIGEST = "SELECT claim_id, md5(q) AS text_md5, length(q) AS text_length FROM t"
ASK = "Which failure mode fits this claim? "


@query("query_zero_shot", f"WITH {CLAIMS}, t AS (SELECT claim_id, concat('{ASK}', narrative) AS q FROM claims) {DIGEST}")
def query_zero_shot(spark, sf):
    return digest(plain_claims(spark, sf).select("claim_id", predict.question(None, "zero", "narrative", "label", "claim_id").alias("q")))


@query(
    "query_one_shot",
    f"""WITH {CLAIMS}, x AS (SELECT * FROM claims WHERE label IS NOT NULL ORDER BY claim_id LIMIT 1),
        t AS (SELECT c.claim_id, concat('Claim: ', x.narrative, ' Failure mode: ', x.label, '. {ASK}', c.narrative) AS q FROM claims c, x)
        {DIGEST}""",
)
def query_one_shot(spark, sf):
    return digest(asked(claims(spark, sf), "one"))


@query(
    "query_few_shot",
    f"""WITH {CLAIMS},
        s AS (SELECT claim_id, label, narrative, row_number() OVER (ORDER BY claim_id) AS n
              FROM (SELECT * FROM claims WHERE label IS NOT NULL ORDER BY claim_id LIMIT 27 OFFSET 153)),
        b AS (SELECT coalesce(string_agg(concat('Example ', n, ': ', narrative, ' Failure mode: ', label), chr(10) ORDER BY n), '') AS block FROM s),
        a AS (SELECT string_agg(l, ',' ORDER BY l) AS labels FROM (SELECT DISTINCT lower(label) AS l FROM claims WHERE label IS NOT NULL)),
        t AS (SELECT c.claim_id, concat(b.block, chr(10), 'Allowed failure modes: ', a.labels, chr(10), '{ASK}', c.narrative) AS q
              FROM claims c, a, b) {DIGEST}""",
)
def query_few_shot(spark, sf):
    return digest(asked(spread_claims(spark, sf), "few"))


# --- prediction -------------------------------------------------------------------------


def embed(text):
    return embedding.embed_text(text, DIMS, element="double")


def embedded(rows):
    """Claims with the vectors of their narratives: what an index holds."""
    return rows.select("claim_id", "label", "narrative", embed(F.col("narrative")).alias("embedding"))


BLANKED = """blanked AS (SELECT * REPLACE (CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 19 = 1 THEN '  ' ELSE text END AS text) FROM documents)"""


def blanked(df, key, text):
    """Some texts missing, some blank, as raw claims have them."""
    return df.withColumn(text, F.when(F.col(key) % 19 == 1, "  ").when(F.col(key) % 19 != 0, F.col(text)))


PREDICTED = f"""{HITS}, predicted AS (
  SELECT h.query_id, e.label AS predicted_label, h.score FROM hits h JOIN embeddings e ON h.claim_id = e.vec_id WHERE h.rank = 1)"""


@query(
    "predict_vector_neighbours",
    f"""WITH {PREDICTED} SELECT e.vec_id AS claim_id, e.label AS actual_label, p.predicted_label, p.score
        FROM embeddings e JOIN predicted p ON e.vec_id = p.query_id""",
)
def predict_vector_neighbours(spark, sf):
    """Labels transferred between given vectors, without texts."""
    known = table(spark, sf, "embeddings").select(F.col("vec_id").alias("claim_id"), "label")
    queries = vector_queries(spark, sf).select("query_id", "embedding")
    found = predict.predict_by_neighbours(queries, vectors(spark, sf), known).withColumnRenamed("query_id", "claim_id")
    return found.join(known.withColumnRenamed("label", "actual_label"), "claim_id").select("claim_id", "actual_label", "predicted_label", "score")


@query(
    "predict_unlabelled_table",
    f"""WITH {BLANKED}, {embedding_sql('emb', 'blanked', 'doc_id', 'text', DIMS)}, {CLAIMS.replace('documents', 'blanked')},
        dense AS (SELECT doc_id, list_transform(range({DIMS}), lambda i: coalesce(map_extract_value(m, i), 0)) AS e
                  FROM (SELECT doc_id, map(list(dim), list(w)) AS m FROM emb GROUP BY doc_id)),
        q AS (SELECT doc_id, e FROM dense JOIN claims ON doc_id = claim_id WHERE label IS NULL),
        v AS (SELECT doc_id, label, e FROM dense JOIN claims ON doc_id = claim_id WHERE label IS NOT NULL),
        hits AS (SELECT q.doc_id AS query_id, v.doc_id AS claim_id, v.label,
                        round(list_inner_product(q.e, v.e), 9) AS score FROM q, v
                 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v.doc_id) <= 10),
        words AS (SELECT doc_id, list_distinct({tokens_sql('text')}) AS w FROM blanked),
        scored AS (SELECT h.*, len(list_intersect(a.w, b.w))::BIGINT AS overlap,
                          row_number() OVER (PARTITION BY query_id ORDER BY h.score DESC, claim_id) AS first_rank
                   FROM hits h JOIN words a ON a.doc_id = query_id JOIN words b ON b.doc_id = claim_id),
        best AS (SELECT query_id, label AS predicted_label, overlap FROM scored
                 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, first_rank) = 1)
        SELECT c.claim_id, b.predicted_label, b.overlap FROM claims c LEFT JOIN best b ON b.query_id = c.claim_id WHERE c.label IS NULL""",
)
def predict_unlabelled_table(spark, sf):
    """Embed every claim into an index table, search the labelled ones for each unlabelled one,
    re-rank by shared words, transfer the label, write the predictions: one row per unlabelled
    claim, without a label where its text is missing or blank, as some are here."""
    index = written(embedded(blanked(spread_claims(spark, sf), "claim_id", "narrative")), "index")
    waiting = index.filter(F.col("label").isNull())
    found = predict.predict(waiting, index, embed, mode="plain", exclude_self=False)
    labels = found.select("claim_id", "predicted_label", F.col("score").cast("long").alias("overlap"))
    name = f"predictions_{scratch_path(spark, '').split('/')[-2]}"
    overwrite_table(labels, name, scratch_path(spark, "predictions"))
    return read_and_drop(spark, name)


# Where the labelled examples of a few-shot question begin in key order, and how many they are.
EXAMPLES = {"offset": 153, "n": 27}


def _mode_sql(mode: str, head: str) -> str:
    return f"""q_{mode} AS (SELECT claim_id AS doc_id, concat({head}, narrative) AS text FROM known),
{embedding_sql(f'e_{mode}', f'q_{mode}', 'doc_id', 'text', DIMS)},
d_{mode} AS (SELECT doc_id, list_transform(range({DIMS}), lambda i: coalesce(map_extract_value(m, i), 0)) AS e
             FROM (SELECT doc_id, map(list(dim), list(w)) AS m FROM e_{mode} GROUP BY doc_id)),
h_{mode} AS (SELECT q.doc_id AS query_id, v.doc_id AS claim_id, round(list_inner_product(q.e, v.e), 9) AS score
             FROM d_{mode} q, d_plain v WHERE q.doc_id <> v.doc_id
             QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v.doc_id) <= 10),
s_{mode} AS (SELECT h.*, len(list_intersect(a.w, b.w)) AS overlap, row_number() OVER (PARTITION BY query_id ORDER BY h.score DESC, claim_id) AS first_rank
             FROM h_{mode} h JOIN words a ON a.doc_id = query_id JOIN words b ON b.doc_id = claim_id),
p_{mode} AS (SELECT s.query_id AS claim_id, k.label, s.overlap FROM s_{mode} s JOIN known k USING (claim_id)
             QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY s.overlap DESC, s.first_rank) = 1)"""


MODES_SQL = f"""{CLAIMS}, known AS (SELECT * FROM claims WHERE label IS NOT NULL),
words AS (SELECT doc_id, list_distinct({tokens_sql('text')}) AS w FROM documents),
x AS (SELECT concat('Claim: ', narrative, ' Failure mode: ', label, '. {ASK}') AS head FROM known ORDER BY claim_id LIMIT 1),
shots AS (SELECT label, narrative, row_number() OVER (ORDER BY claim_id) AS n
          FROM (SELECT * FROM known ORDER BY claim_id LIMIT {EXAMPLES['n']} OFFSET {EXAMPLES['offset']})),
f AS (SELECT concat((SELECT coalesce(string_agg(concat('Example ', n, ': ', narrative, ' Failure mode: ', label), chr(10) ORDER BY n), '') FROM shots),
             chr(10), 'Allowed failure modes: ', (SELECT string_agg(l, ',' ORDER BY l) FROM (SELECT DISTINCT lower(label) AS l FROM known)),
             chr(10), '{ASK}') AS head),
{_mode_sql('plain', "''")},
{_mode_sql('zero', f"'{ASK}'")},
{_mode_sql('one', '(SELECT head FROM x)')},
{_mode_sql('few', '(SELECT head FROM f)')},
predicted AS (
  SELECT k.claim_id, k.label AS actual_label, z.label AS zero_shot, o.label AS one_shot, w.label AS few_shot
  FROM known k LEFT JOIN p_zero z USING (claim_id) LEFT JOIN p_one o USING (claim_id) LEFT JOIN p_few w USING (claim_id))"""


def mode_predictions(spark, sf):
    """Every labelled claim predicted from the others in three ways, beside its actual label."""
    index = written(embedded(spread_claims(spark, sf).filter(F.col("label").isNotNull())), "index")
    rows = index.select("claim_id", F.col("label").alias("actual_label"))
    for mode in ("zero", "one", "few"):
        found = predict.predict(index, index, embed, mode=mode, **EXAMPLES)
        rows = rows.join(found.select("claim_id", F.col("predicted_label").alias(f"{mode}_shot")), "claim_id", "left")
    return rows


@query(
    "predict_by_neighbours",
    f"""WITH {MODES_SQL} SELECT k.claim_id, k.label AS actual_label, z.label AS predicted_label, z.overlap::DOUBLE AS score
        FROM known k LEFT JOIN p_zero z USING (claim_id)""",
)
def predict_by_neighbours(spark, sf):
    """Every labelled claim asked for without examples, searched among the others, re-ranked, and given the best hit's label."""
    index = written(embedded(spread_claims(spark, sf).filter(F.col("label").isNotNull())), "index")
    found = predict.predict(index, index, embed, mode="zero")
    return index.select("claim_id", F.col("label").alias("actual_label")).join(found, "claim_id").select(
        "claim_id", "actual_label", "predicted_label", "score"
    )


@query("predict_modes", f"WITH {MODES_SQL} SELECT * FROM predicted")
def predict_modes(spark, sf):
    return mode_predictions(spark, sf)


@query(
    "predict_mode_accuracy",
    f"""WITH {MODES_SQL}, m AS (
          SELECT 'zero' AS mode, actual_label = zero_shot AS hit FROM predicted
          UNION ALL SELECT 'one', actual_label = one_shot FROM predicted UNION ALL SELECT 'few', actual_label = few_shot FROM predicted)
        SELECT mode, count(*) AS cnt, round(avg(coalesce(hit, false)::INT) * 100, 6) AS accuracy FROM m GROUP BY mode""",
)
def predict_mode_accuracy(spark, sf):
    cells = [F.struct(F.lit(m).alias("mode"), F.col(f"{m}_shot").alias("predicted")) for m in ("zero", "one", "few")]
    long = mode_predictions(spark, sf).select("actual_label", F.explode(F.array(*cells)).alias("c")).select("actual_label", "c.*")
    accuracy = F.round(aggregates.accuracy_percent("actual_label", "predicted"), 6).alias("accuracy")
    return long.groupBy("mode").agg(F.count(F.lit(1)).alias("cnt"), accuracy)


# --- classifiers ------------------------------------------------------------------------


def split_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("label", F.col("label").cast("string"))
    parted = sampling.split_stratified(rows, "label", "vec_id", 0.2)
    return parted.filter(F.col("is_test") == 0), parted.filter(F.col("is_test") == 1)


SPLIT_SQL = """r AS (
  SELECT vec_id, label::VARCHAR AS label, embedding::DOUBLE[] AS e,
         row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) AS is_test
  FROM embeddings)"""

# The covariance system is solved by Gauss-Jordan steps over a matrix that holds the class means as further columns.
DISCRIMINANT_SQL = f"""WITH RECURSIVE {SPLIT_SQL},
x AS (SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM r WHERE NOT is_test),
mu AS (SELECT label, d, avg(x) AS m FROM x GROUP BY ALL),
cls AS (SELECT label, count(*) AS c, row_number() OVER (ORDER BY label) AS n FROM r WHERE NOT is_test GROUP BY label),
z AS (SELECT vec_id, d, x - m AS z FROM x JOIN mu USING (label, d)),
cov AS (SELECT a.d AS i, b.d AS j, sum(a.z * b.z) / (SELECT sum(c) FROM cls) AS s FROM z a JOIN z b USING (vec_id) GROUP BY ALL),
wide AS (
  SELECT i, j, s + CASE WHEN i = j THEN 0.01::DOUBLE * (SELECT sum(s) / {DIMS} FROM cov WHERE i = j) + 1e-12 ELSE 0 END AS v FROM cov
  UNION ALL SELECT d, {DIMS} + n, m FROM mu JOIN cls USING (label)),
steps AS (
  SELECT 1 AS k, (SELECT list(line ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS line FROM wide GROUP BY i)) AS a
  UNION ALL
  SELECT k + 1, [CASE WHEN i = k THEN [y / a[k][k] FOR y IN a[k]]
                 ELSE [a[i][j] - a[i][k] * a[k][j] / a[k][k] FOR j IN range(1, len(a[1]) + 1)] END FOR i IN range(1, {DIMS + 1})]
  FROM steps WHERE k <= {DIMS}),
w AS (
  SELECT label, n, [a[i][{DIMS} + n] FOR i IN range(1, {DIMS + 1})] AS w, ln(c / sum(c) OVER ()) AS prior
  FROM cls CROSS JOIN (SELECT a FROM steps WHERE k = {DIMS + 1})),
model AS (SELECT label, w, prior - list_inner_product(w, mean) / 2 AS bias FROM w JOIN (SELECT label, list(m ORDER BY d) AS mean FROM mu GROUP BY label) USING (label)),
scored AS (SELECT vec_id, r.label AS actual_label, model.label AS predicted_label, list_inner_product(e, w) + bias AS s FROM r, model WHERE is_test),
found AS (
  SELECT vec_id, actual_label, predicted_label, round(s, 6) AS score,
         round(1 / sum(exp(s - top)) OVER (PARTITION BY vec_id), 6) AS probability,
         row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, predicted_label) AS place
  FROM (SELECT *, max(s) OVER (PARTITION BY vec_id) AS top FROM scored))
SELECT vec_id, actual_label, predicted_label, score, probability FROM found WHERE place = 1"""


@query("ml_embedding_classifier", DISCRIMINANT_SQL)
def ml_embedding_classifier(spark, sf):
    train, test = split_vectors(spark, sf)
    model = classify.fit_embedding_classifier(train, "embedding", "label")
    found = classify.predict_embeddings(model, test, "embedding", "vec_id", "label")
    numbers = [F.round(c, 6).alias(c) for c in ("score", "probability")]
    return found.select("vec_id", F.col("label").alias("actual_label"), "predicted_label", *numbers)


LABELLED_SPLIT = f"""{CLAIMS},
parted AS (
  SELECT claim_id, label, label IS NULL OR row_number() OVER (PARTITION BY label ORDER BY md5(claim_id::VARCHAR), claim_id)
                                           <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) AS apart,
         narrative FROM claims)"""

TEXT_MODEL_SQL = f"""{LABELLED_SPLIT},
toks AS (SELECT claim_id, unnest({tokens_sql('lower(narrative)')}) AS t FROM parted),
counts AS (SELECT claim_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {classify.TERM_BUCKETS} AS bucket, count(*) AS n FROM toks GROUP BY ALL),
known AS (SELECT claim_id, label FROM parted WHERE NOT apart),
per_term AS (SELECT label, bucket, sum(n) AS n FROM counts JOIN known USING (claim_id) GROUP BY ALL),
classes AS (
  SELECT label, ln(c / sum(c) OVER ()) AS prior, ln(1 / (coalesce(t, 0) + {classify.TERM_BUCKETS}::DOUBLE)) AS base
  FROM (SELECT label, count(*) AS c FROM known GROUP BY label) LEFT JOIN (SELECT label, sum(n) AS t FROM per_term GROUP BY label) USING (label)),
sums AS (SELECT c.claim_id, m.label, sum(c.n * ln(m.n + 1)) AS s FROM counts c JOIN per_term m USING (bucket) GROUP BY ALL),
size AS (SELECT claim_id, coalesce(sum(n), 0) AS n FROM parted LEFT JOIN counts USING (claim_id) WHERE apart GROUP BY claim_id),
scored AS (SELECT z.claim_id, c.label, prior + z.n * base + coalesce(s, 0) AS s FROM size z CROSS JOIN classes c LEFT JOIN sums u ON u.claim_id = z.claim_id AND u.label = c.label),
predicted AS (
  SELECT claim_id, label AS predicted_label, 1 / sum(exp(s - top)) OVER (PARTITION BY claim_id) AS probability,
         row_number() OVER (PARTITION BY claim_id ORDER BY round(s, 9) DESC, label) AS place
  FROM (SELECT *, max(s) OVER (PARTITION BY claim_id) AS top FROM scored))"""


def text_predictions(spark, sf):
    """(claim_id, label, terms, predicted_label, probability) of every claim that the model was not trained on: a fifth of the
    labelled ones and all others. Each text is read once."""
    rows = spread_claims(spark, sf).select("claim_id", "label", "narrative")
    facts = written(claims(spark, sf).select("claim_id", "label"), "labels")
    apart = sampling.split_stratified(facts.where("label is not null"), "label", "claim_id", 0.2)
    training = written(apart.where("is_test = 0").select("claim_id", "label"), "training")
    counts = written(classify.term_counts(rows, "claim_id", "narrative"), "terms")
    model = classify.fit_text_model(counts, training, "claim_id", "label")
    waiting = counts.join(training, "claim_id", "left_anti")
    sizes = waiting.groupBy("claim_id").agg(F.sum(F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0)).alias("terms"))
    found = classify.predict_texts(model, waiting, "claim_id")
    return found.join(sizes, "claim_id").join(facts, "claim_id")


@query(
    "ml_text_classifier",
    f"WITH {TEXT_MODEL_SQL} SELECT claim_id, predicted_label, round(probability, 6) AS probability FROM predicted WHERE place = 1",
)
def ml_text_classifier(spark, sf):
    return text_predictions(spark, sf).select("claim_id", "predicted_label", F.round("probability", 6).alias("probability"))


@query(
    "ml_text_accuracy",
    f"""WITH {TEXT_MODEL_SQL}
        SELECT p.label, count(*) AS cnt, round(avg((predicted_label = p.label)::INT) * 100, 6) AS accuracy
        FROM predicted JOIN parted p USING (claim_id) WHERE place = 1 AND p.label IS NOT NULL GROUP BY p.label""",
)
def ml_text_accuracy(spark, sf):
    """How often the text classifier is right about labelled claims that it was not trained on, by their label."""
    held_out = text_predictions(spark, sf).where("label is not null")
    accuracy = F.round(aggregates.accuracy_percent("label", "predicted_label"), 6).alias("accuracy")
    return held_out.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"), accuracy)


TERM_LIMIT = 512
FALLBACK_SQL = f"""{TEXT_MODEL_SQL},
answered AS (
  SELECT claim_id, CASE WHEN z.n <= {TERM_LIMIT} THEN coalesce(predicted_label, 'Too Long Input') ELSE 'Too Long Input' END AS predicted_label
  FROM size z LEFT JOIN (SELECT * FROM predicted WHERE place = 1) USING (claim_id))"""


def answered(spark, sf):
    accepted = F.col("terms") <= TERM_LIMIT
    return text_predictions(spark, sf).withColumn("predicted_label", predict.with_fallback("predicted_label", accepted))


@query("predict_with_fallback", f"WITH {FALLBACK_SQL} SELECT claim_id, predicted_label FROM answered")
def predict_with_fallback(spark, sf):
    """The text classifier on every claim outside its training ids; inputs beyond 512 terms get the fallback label."""
    return answered(spark, sf).select("claim_id", "predicted_label")


@query(
    "predict_fallback_accuracy",
    f"""WITH {FALLBACK_SQL}
        SELECT count(*) AS cnt, count_if(predicted_label = 'Too Long Input') AS too_long, round(avg((predicted_label = label)::INT) * 100, 6) AS accuracy
        FROM answered JOIN parted USING (claim_id) WHERE label IS NOT NULL""",
)
def predict_fallback_accuracy(spark, sf):
    """Accuracy over all labelled claims outside the training ids; a fallback is a miss."""
    rows = answered(spark, sf).where("label is not null")
    return rows.agg(
        F.count(F.lit(1)).alias("cnt"),
        F.count_if(F.col("predicted_label") == predict.TOO_LONG).alias("too_long"),
        F.round(aggregates.accuracy_percent("label", "predicted_label"), 6).alias("accuracy"),
    )


@query(
    "ml_centroid_classifier",
    """WITH r AS (SELECT vec_id, label::VARCHAR AS label, embedding::DOUBLE[] AS e,
                         row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id)
                           <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) AS is_test FROM embeddings),
            x AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM r WHERE NOT is_test),
            c AS (SELECT label, list(m ORDER BY d) AS e FROM (SELECT label, d, avg(x) AS m FROM x GROUP BY ALL) GROUP BY label)
       SELECT r.vec_id, r.label AS actual_label, c.label AS predicted_label, round(list_inner_product(r.e, c.e), 9) AS score
       FROM r, c WHERE r.is_test
       QUALIFY row_number() OVER (PARTITION BY r.vec_id ORDER BY round(list_inner_product(r.e, c.e), 9) DESC, c.label) = 1""",
)
def ml_centroid_classifier(spark, sf):
    train, test = split_vectors(spark, sf)
    found = classify.predict_by_centroid(test, classify.centroids(train, "label", "embedding"), "label", "vec_id", "embedding")
    return found.join(test.select("vec_id", F.col("label").alias("actual_label")), "vec_id").select(
        "vec_id", "actual_label", "predicted_label", "score"
    )


# --- evaluation -------------------------------------------------------------------------

KS = range(1, 11)
FLOOR = 0.4
MEASURES_SQL = """
k AS (SELECT unnest(range(1, 11)) AS k),
gain_{n} AS (SELECT h.query_id, h.rank, (q.label = c.label)::INT AS rel FROM {hits} h
             JOIN embeddings q ON q.vec_id = h.query_id JOIN embeddings c ON c.vec_id = h.claim_id),
size_{n} AS (SELECT vec_id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n FROM embeddings),
at_{n} AS (SELECT k.k, g.query_id, sum(CASE WHEN g.rank <= k.k THEN rel ELSE 0 END) AS hits,
                  sum(CASE WHEN g.rank <= k.k THEN rel / log2(g.rank + 1) ELSE 0 END) AS dcg
           FROM gain_{n} g, k GROUP BY ALL)"""


def label_judged(spark, sf, hits):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return evaluate.judged_by_label(hits, labels), evaluate.label_target_sizes(labels)


@query(
    "eval_label_recall_at_k",
    f"""WITH {HITS}, near AS (SELECT * FROM hits WHERE score >= {FLOOR}), {MEASURES_SQL.format(n='a', hits='near')}
        SELECT k.k, round(sum(coalesce(a.hits / s.n, 0)) / count(*), 6) AS recall
        FROM size_a s CROSS JOIN k LEFT JOIN at_a a ON a.query_id = s.query_id AND a.k = k.k WHERE s.n > 0 GROUP BY k.k""",
)
def eval_label_recall_at_k(spark, sf):
    """Hits of a low score are dropped first, so some queries have none; they count all the same."""
    judged, sizes = label_judged(spark, sf, vector_hits(spark, sf).filter(F.col("score") >= FLOOR))
    return evaluate.recall_at_k(judged, sizes, KS).withColumn("recall", F.round("recall", 6))


SIGNS = "list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END)"


@query(
    "eval_label_recall_compare",
    f"""WITH {HITS}, {hits_sql('coarse', vector=SIGNS)}, {MEASURES_SQL.format(n='a', hits='hits')},
        {MEASURES_SQL.format(n='b', hits='coarse').replace('k AS (SELECT unnest(range(1, 11)) AS k),', '')}
        SELECT x.k, x.r AS recall_a, y.r AS recall_b
        FROM (SELECT a.k, round(avg(a.hits / s.n), 6) AS r FROM at_a a JOIN size_a s USING (query_id) WHERE s.n > 0 GROUP BY a.k) x
        JOIN (SELECT a.k, round(avg(a.hits / s.n), 6) AS r FROM at_b a JOIN size_b s USING (query_id) WHERE s.n > 0 GROUP BY a.k) y
        ON x.k = y.k""",
)
def eval_label_recall_compare(spark, sf):
    """The full vectors against an index that keeps only their signs."""
    judged_a, sizes = label_judged(spark, sf, vector_hits(spark, sf))
    signs = F.transform("embedding", lambda x: F.when(x > 0, 0.125).otherwise(-0.125))
    coarse = search.topk(
        vector_queries(spark, sf).withColumn("embedding", signs), vectors(spark, sf).withColumn("embedding", signs), 10
    )
    judged_b, _ = label_judged(spark, sf, coarse)
    both = evaluate.recall_compare(evaluate.recall_at_k(judged_a, sizes, KS), evaluate.recall_at_k(judged_b, sizes, KS))
    return both.select("k", F.round("recall_a", 6).alias("recall_a"), F.round("recall_b", 6).alias("recall_b"))


@query(
    "eval_label_retriever_defaults",
    f"""WITH {HITS}, {MEASURES_SQL.format(n='a', hits='hits')},
        ideal AS (SELECT unnest(range(1, 11)) AS m, list_sum(list_transform(range(1, m + 1), lambda i: 1 / log2(i + 1))) AS best)
        SELECT a.k, round(avg(a.hits / a.k), 6) AS precision, round(avg(a.hits / s.n), 6) AS recall,
               round(avg(a.dcg / i.best), 6) AS ndcg
        FROM at_a a JOIN size_a s USING (query_id) JOIN ideal i ON i.m = least(a.k, s.n) WHERE s.n > 0 GROUP BY a.k""",
)
def eval_label_retriever_defaults(spark, sf):
    judged, sizes = label_judged(spark, sf, vector_hits(spark, sf))
    found = evaluate.retriever_measures(judged, sizes, KS)
    return found.select("k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")])


def _dense_sql(name: str, source: str, dims: int) -> str:
    return f"""{embedding_sql(f'e_{name}', source, 'doc_id', 'text', dims)},
d_{name} AS (SELECT doc_id, list_transform(range({dims}), lambda i: coalesce(map_extract_value(m, i), 0)) AS e
             FROM (SELECT doc_id, map(list(dim), list(w)) AS m FROM e_{name} GROUP BY doc_id))"""


def _target_sql(name: str, dims: int) -> str:
    """Hits of questions among the claims in ``dims`` dimensions, and which of them are the question's target."""
    return f"""{_dense_sql(f'q{name}', 'questions', dims)}, {_dense_sql(f'v{name}', 'texts', dims)},
hits_{name} AS (SELECT q.doc_id AS query_id, v.doc_id AS claim_id, round(list_inner_product(q.e, v.e), 9) AS score,
                       row_number() OVER (PARTITION BY q.doc_id ORDER BY round(list_inner_product(q.e, v.e), 9) DESC, v.doc_id) AS rank
                FROM d_q{name} q, d_v{name} v QUALIFY rank <= 10),
found_{name} AS (SELECT d.doc_id AS query_id, h.rank FROM questions d LEFT JOIN hits_{name} h ON h.query_id = d.doc_id AND h.claim_id = d.doc_id)"""


COARSE_DIMS = 16
TARGETS_SQL = f"""{CLAIMS}, texts AS (SELECT claim_id AS doc_id, narrative AS text FROM claims),
questions AS (SELECT claim_id AS doc_id, concat('{ASK}', narrative) AS text FROM claims WHERE label IS NOT NULL),
k AS (SELECT unnest(range(1, 11)) AS k), {_target_sql('a', DIMS)}"""


def target_hits(spark, sf, dims):
    """Labelled claims' questions searched among all claims' texts; each question's own claim is its target, given by id."""
    rows = spread_claims(spark, sf)
    vector = lambda text: embedding.embed_text(text, dims, element="double")
    made = written(
        rows.select(
            "claim_id",
            vector(F.col("narrative")).alias("embedding"),
            # The condition stands inside: outside, every question would be embedded.
            vector(F.when(F.col("label").isNotNull(), predict.question(None, "zero", "narrative", "label", "claim_id"))).alias("asked"),
        ),
        "embedded",
    )
    usable = F.exists("embedding", lambda x: x != 0)
    questions = made.filter(F.exists("asked", lambda x: x != 0)).select(F.col("claim_id").alias("query_id"), F.col("asked").alias("embedding"))
    hits = search.topk(questions, made.filter(usable), 10, exclude_self=False)
    targets = rows.filter(F.col("label").isNotNull()).select(F.col("claim_id").alias("query_id"), "claim_id")
    return evaluate.judged_hits(hits, targets), evaluate.target_sizes(targets)


@query(
    "eval_recall_at_k",
    f"""WITH {TARGETS_SQL} SELECT k.k, round(avg(coalesce(rank <= k.k, false)::INT), 6) AS recall FROM found_a, k GROUP BY k.k""",
)
def eval_recall_at_k(spark, sf):
    judged, sizes = target_hits(spark, sf, DIMS)
    return evaluate.recall_at_k(judged, sizes, KS).withColumn("recall", F.round("recall", 6))


@query(
    "eval_recall_compare",
    f"""WITH {TARGETS_SQL}, {_target_sql('b', COARSE_DIMS)},
        x AS (SELECT k.k, avg(coalesce(rank <= k.k, false)::INT) AS r FROM found_a, k GROUP BY k.k),
        y AS (SELECT k.k, avg(coalesce(rank <= k.k, false)::INT) AS r FROM found_b, k GROUP BY k.k)
        SELECT k, round(x.r, 6) AS recall_a, round(y.r, 6) AS recall_b FROM x JOIN y USING (k)""",
)
def eval_recall_compare(spark, sf):
    """Two indexes of the same claims side by side: 64 and 16 dimensions."""
    curves = [evaluate.recall_at_k(*target_hits(spark, sf, dims), KS) for dims in (DIMS, COARSE_DIMS)]
    return evaluate.recall_compare(*curves).select("k", F.round("recall_a", 6).alias("recall_a"), F.round("recall_b", 6).alias("recall_b"))


@query(
    "eval_retriever_defaults",
    f"""WITH {TARGETS_SQL}
        SELECT k.k, round(avg(coalesce(rank <= k.k, false)::INT / k.k), 6) AS precision, round(avg(coalesce(rank <= k.k, false)::INT), 6) AS recall,
               round(avg(CASE WHEN rank <= k.k THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg
        FROM found_a, k GROUP BY k.k""",
)
def eval_retriever_defaults(spark, sf):
    judged, sizes = target_hits(spark, sf, DIMS)
    found = evaluate.retriever_measures(judged, sizes, KS)
    return found.select("k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")])


@query(
    "eval_exact_match",
    """SELECT d.lang AS data_set, count(*) AS cnt, round(avg((l.quality = 1 - l.toxic)::INT), 6) AS exact_match
       FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang""",
)
def eval_exact_match(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select(
        F.col("lang").alias("data_set"), F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("predicted")
    )
    found = evaluate.exact_match_by_set(rows, "data_set", "actual", "predicted")
    return found.withColumn("exact_match", F.round("exact_match", 6))


@query(
    "eval_real_vs_synthetic",
    f"""WITH {CLAIMS},
        v AS (SELECT 'engine' AS feature, engine AS value, label IS NOT NULL AS is_real FROM claims
              UNION ALL SELECT 'failcode', failcode, label IS NOT NULL FROM claims),
        n AS (SELECT feature, value, count_if(is_real) AS a, count_if(NOT is_real) AS b FROM v GROUP BY feature, value),
        t AS (SELECT feature, sum(a) AS a, sum(b) AS b FROM n GROUP BY feature)
        SELECT n.feature, round(sum(abs(n.a / t.a - n.b / t.b)) / 2, 6) AS distance
        FROM n JOIN t ON n.feature = t.feature GROUP BY n.feature""",
)
def eval_real_vs_synthetic(spark, sf):
    """Labelled claims stand for the real set, unlabelled ones for the synthetic set."""
    rows = claims(spark, sf)
    found = evaluate.distribution_distance(
        rows.filter(F.col("label").isNotNull()), rows.filter(F.col("label").isNull()), ["engine", "failcode"]
    )
    return found.withColumn("distance", F.round("distance", 6))
