"""Joins, aggregates, windows, samples and features over the given tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from claimlens.functions import cleanse
from claimlens.operators import aggregates, features, joins, sampling, windows
from claimlens.plans.registry import query
from claimlens.plans.views import CLAIMS, DIRTY, HITS, claims, dirty_claims, table, vector_hits
from claimlens.session import written

# --- joins ------------------------------------------------------------------------------


@query(
    "join_inner_equi",
    f"""WITH {CLAIMS}, n AS (SELECT label, count(*) AS cnt FROM claims GROUP BY label)
        SELECT c.claim_id, c.label, n.cnt FROM claims c JOIN n ON c.label = n.label""",
)
def join_inner_equi(spark, sf):
    return joins.with_group_counts(claims(spark, sf).select("claim_id", "label"), ["label"])


@query("join_semi_keys", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def join_semi_keys(spark, sf):
    return joins.semi_keys(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


@query(
    "join_anti_keys",
    """WITH d AS (SELECT CASE WHEN doc_id % 17 <> 0 THEN doc_id END AS doc_id, source, n_chars FROM documents)
       SELECT doc_id, source, n_chars FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def join_anti_keys(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 17 != 0, F.col("doc_id")).alias("doc_id"), "source", "n_chars"
    )
    return joins.anti_keys(rows, table(spark, sf, "labels"), "doc_id")


@query(
    "join_label_lookup",
    f"WITH {HITS} SELECT h.query_id, h.claim_id, h.rank, e.label FROM hits h JOIN embeddings e ON h.claim_id = e.vec_id",
)
def join_label_lookup(spark, sf):
    known = table(spark, sf, "embeddings").select(F.col("vec_id").alias("claim_id"), "label")
    return joins.lookup_labels(vector_hits(spark, sf), known, "claim_id", "label").select("query_id", "claim_id", "rank", "label")


TEXT_HITS = f"""{HITS}, text_hits AS (
  SELECT h.query_id, h.claim_id, h.rank, d.lang || ' ' || d.source AS chunk
  FROM hits h LEFT JOIN documents d ON h.claim_id = d.doc_id)"""


def text_hits(spark, sf):
    """Hits with a short code chunk each; such chunks repeat within a query, and are missing where a vector has no document."""
    chunks = table(spark, sf, "documents").select(
        F.col("doc_id").alias("claim_id"), F.concat("lang", F.lit(" "), "source").alias("chunk")
    )
    return vector_hits(spark, sf).join(chunks, "claim_id", "left").select("query_id", "claim_id", "rank", "chunk")


@query(
    "join_hits_by_text",
    f"""WITH {TEXT_HITS},
        ranked AS (SELECT query_id, chunk, min(rank) AS best FROM text_hits GROUP BY ALL)
        SELECT h.query_id, h.claim_id, min(r.best)::BIGINT AS rank
        FROM ranked r JOIN text_hits h ON r.query_id = h.query_id AND r.chunk IS NOT DISTINCT FROM h.chunk GROUP BY ALL""",
)
def join_hits_by_text(spark, sf):
    hits = text_hits(spark, sf)
    ranked = hits.groupBy("query_id", "chunk").agg(F.min("rank").alias("rank"))
    mapped = joins.hits_by_text(ranked, hits.drop("rank"), "chunk")
    return mapped.withColumn("rank", F.col("rank").cast("long"))


@query(
    "join_align_by_key",
    """SELECT d.doc_id, d.source, l.quality AS actual, 1 - l.toxic AS predicted
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def join_align_by_key(spark, sf):
    labels = table(spark, sf, "labels")
    return joins.align_by_key(
        "doc_id",
        labels.select("doc_id", F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("predicted")),
        table(spark, sf, "documents").select("doc_id", "source"),
    )


# --- aggregates -------------------------------------------------------------------------


@query("agg_count_by_label", f"WITH {CLAIMS} SELECT coalesce(label, 'none') AS label, count(*) AS cnt FROM claims GROUP BY ALL")
def agg_count_by_label(spark, sf):
    return aggregates.count_by(claims(spark, sf), "label").withColumn("label", F.coalesce("label", F.lit("none")))


@query("agg_count_rows", "SELECT count(*) AS cnt FROM orders")
def agg_count_rows(spark, sf):
    return aggregates.count_rows(table(spark, sf, "orders"))


@query("agg_distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def agg_distinct_values(spark, sf):
    return aggregates.distinct_values(table(spark, sf, "orders"), "o_orderpriority")


@query("agg_count_distinct", f"WITH {CLAIMS} SELECT count(DISTINCT label) AS cnt FROM claims")
def agg_count_distinct(spark, sf):
    return aggregates.count_distinct(claims(spark, sf), "label")


@query(
    "agg_having_count",
    "SELECT l_orderkey, count(*) AS cnt FROM lineitem GROUP BY l_orderkey HAVING count(*) = 4",
)
def agg_having_count(spark, sf):
    return aggregates.groups_of_size(table(spark, sf, "lineitem"), "l_orderkey", F.col("cnt") == 4)


@query(
    "agg_max_class_count",
    "SELECT max(cnt) AS max_cnt FROM (SELECT count(*) AS cnt FROM orders GROUP BY o_orderpriority)",
)
def agg_max_class_count(spark, sf):
    return aggregates.max_class_count(table(spark, sf, "orders"), "o_orderpriority")


@query(
    "agg_concat_labels",
    f"""WITH {CLAIMS} SELECT string_agg(l, ',' ORDER BY l) AS labels
        FROM (SELECT DISTINCT lower(label) AS l FROM claims WHERE label IS NOT NULL)""",
)
def agg_concat_labels(spark, sf):
    return aggregates.concat_labels(claims(spark, sf), "label")


@query(
    "agg_concat_examples",
    """WITH s AS (SELECT conv_id, turn, text, row_number() OVER (ORDER BY conv_id, turn) AS n
                  FROM (SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 27 OFFSET 153)),
            b AS (SELECT coalesce(string_agg(concat('Example ', n, ': ', text), chr(10) ORDER BY n), '') AS examples FROM s)
       SELECT md5(examples) AS examples_md5, length(examples) AS examples_length FROM b""",
)
def agg_concat_examples(spark, sf):
    turns = table(spark, sf, "conversations")
    block = aggregates.concat_examples(turns, F.col("text"), ["conv_id", "turn"], 153, 27)
    return block.select(
        F.md5("examples").alias("examples_md5"), F.length("examples").cast("long").alias("examples_length")
    )


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Some taxes are missing, as in raw files.
GAPPY = "(SELECT * REPLACE (CASE WHEN l_linenumber <> 4 THEN l_tax END AS l_tax) FROM lineitem)"


def measures(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.withColumn("l_tax", F.when(F.col("l_linenumber") != 4, F.col("l_tax"))).select(*MEASURES)


MATRIX_SQL = " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS i, {j}::BIGINT AS j, round(corr({a}, {b}), 6) AS r FROM {GAPPY}"
    for i, a in enumerate(MEASURES)
    for j, b in enumerate(MEASURES)
)


@query("agg_correlation_matrix", MATRIX_SQL)
def agg_correlation_matrix(spark, sf):
    matrix = aggregates.correlation_matrix(measures(spark, sf), MEASURES)
    return matrix.withColumn("r", F.round("r", 6))


@query(
    "agg_correlation_pairs",
    " UNION ALL ".join(
        f"SELECT '{MEASURES[i]}' AS feature_a, '{MEASURES[j]}' AS feature_b, round(corr({MEASURES[i]}, {MEASURES[j]}), 6) AS r FROM {GAPPY}"
        for i in range(len(MEASURES))
        for j in range(i)
    ),
)
def agg_correlation_pairs(spark, sf):
    matrix = aggregates.correlation_matrix(measures(spark, sf), MEASURES)
    return aggregates.correlation_pairs(matrix, MEASURES).withColumn("r", F.round("r", 6))


@query(
    "agg_onehot_correlation",
    """WITH gappy AS (SELECT p_type, p_retailprice, CASE WHEN p_partkey % 7 <> 0 THEN p_size::DOUBLE END AS p_size FROM part),
       v AS (SELECT DISTINCT p_type AS value FROM gappy)
       SELECT value, 'p_size' AS feature, round(corr((p_type = value)::INT::DOUBLE, p_size), 6) AS r
       FROM gappy, v GROUP BY value
       UNION ALL
       SELECT value, 'p_retailprice', round(corr((p_type = value)::INT::DOUBLE, p_retailprice), 6) FROM gappy, v GROUP BY value""",
)
def agg_onehot_correlation(spark, sf):
    """Some sizes are missing, as in raw files."""
    gappy = table(spark, sf, "part").withColumn("p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")))
    found = aggregates.onehot_correlation(gappy, "p_type", ["p_size", "p_retailprice"])
    return found.withColumn("r", F.round("r", 6))


@query(
    "agg_retrieved_ids",
    f"WITH {HITS} SELECT query_id, string_agg(claim_id::VARCHAR, ',' ORDER BY rank) AS retrieved FROM hits GROUP BY query_id",
)
def agg_retrieved_ids(spark, sf):
    found = aggregates.retrieved_ids(vector_hits(spark, sf))
    return found.select("query_id", F.array_join(F.col("retrieved").cast("array<string>"), ",").alias("retrieved"))


@query(
    "agg_majority_label",
    f"""WITH {HITS}, v AS (
          SELECT h.query_id, e.label, count(*) AS votes, min(h.rank) AS best
          FROM hits h JOIN embeddings e ON h.claim_id = e.vec_id GROUP BY ALL)
        SELECT query_id, label, votes FROM v
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, best, label) = 1""",
)
def agg_majority_label(spark, sf):
    known = table(spark, sf, "embeddings").select(F.col("vec_id").alias("claim_id"), "label")
    hits = joins.lookup_labels(vector_hits(spark, sf), known, "claim_id", "label")
    return aggregates.majority_label(hits).select("query_id", "label", "votes")


@query(
    "agg_accuracy",
    "SELECT count(*) AS cnt, round(avg((quality = 1 - toxic)::INT) * 100, 6) AS accuracy FROM labels",
)
def agg_accuracy(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("predicted"))
    return rows.agg(
        F.count(F.lit(1)).alias("cnt"), F.round(aggregates.accuracy_percent("actual", "predicted"), 6).alias("accuracy")
    )


@query(
    "agg_weighted_mean",
    """SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss,
              round(count_if(l_tax > 0.04) / sum(l_quantity), 6) AS accuracy FROM lineitem GROUP BY l_returnflag""",
)
def agg_weighted_mean(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(aggregates.weighted_mean("l_discount", "l_quantity"), 6).alias("loss"),
        F.round(F.count_if(F.col("l_tax") > 0.04) / F.sum("l_quantity"), 6).alias("accuracy"),
    )


@query("agg_score_mean_variance", "SELECT round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance FROM events")
def agg_score_mean_variance(spark, sf):
    measured = aggregates.mean_variance(table(spark, sf, "events"), "value")
    return measured.select(F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query("agg_valid_share", f"WITH {CLAIMS} SELECT round(count(label) * 100.0::DOUBLE / count(*), 6) AS valid_share FROM claims")
def agg_valid_share(spark, sf):
    share = aggregates.valid_share(F.col("label").isNotNull())
    return claims(spark, sf).agg(F.round(share, 6).alias("valid_share"))


# --- windows, order, limit --------------------------------------------------------------


NUMBERED = "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) AS rn FROM orders"


def numbered(spark, sf, **size):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return windows.ranked_rows(rows, ["o_orderpriority"], ["o_custkey", "o_orderkey"], **size).drop("o_custkey")


@query("win_row_number", NUMBERED)
def win_row_number(spark, sf):
    return numbered(spark, sf)


@query("win_row_number_ranges", NUMBERED)
def win_row_number_ranges(spark, sf):
    """The plan for groups beyond a bound, which small tables never reach by themselves."""
    return numbered(spark, sf, rows_per_bucket=1_000)


@query(
    "win_top_n_per_group",
    """SELECT o_orderkey, o_orderpriority, rn FROM (
         SELECT o_orderkey, o_orderpriority,
                row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INT AS rn FROM orders)
       WHERE rn <= 5""",
)
def win_top_n_per_group(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return windows.top_n_per_group(rows, ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 5).drop("o_totalprice")


@query("win_first_per_query", f"WITH {HITS} SELECT query_id, claim_id, score FROM hits WHERE rank = 1")
def win_first_per_query(spark, sf):
    best = windows.first_per_query(vector_hits(spark, sf), "query_id", ["rank"])
    return best.select("query_id", "claim_id", "score")


@query("sort_by_score", f"WITH {HITS} SELECT query_id, claim_id, score FROM hits ORDER BY hits.score DESC, query_id, claim_id")
def sort_by_score(spark, sf):
    ordered = vector_hits(spark, sf).orderBy(F.desc("score"), "query_id", "claim_id")
    return ordered.select("query_id", "claim_id", "score")


@query("limit_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_rows(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return windows.limit_rows(rows, [F.desc("o_totalprice"), "o_orderkey"], 25)


@query(
    "limit_offset_slice",
    "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations ORDER BY conv_id, turn LIMIT 27 OFFSET 153",
)
def limit_offset_slice(spark, sf):
    rows = windows.slice_rows(table(spark, sf, "conversations"), ["conv_id", "turn"], 153, 27)
    return rows.select("conv_id", "turn", F.md5("text").alias("text_md5"))


# --- unions, samples, splits ------------------------------------------------------------

CLASSES = """d AS (SELECT doc_id, concat(lang, '/', source, '/', n_chars % 5) AS class FROM documents),
n AS (SELECT class, count(*) AS size FROM d GROUP BY class)"""


def classed(spark, sf):
    """Documents in many small classes, single ones among them."""
    name = F.concat_ws("/", "lang", "source", (F.col("n_chars") % 5).cast("string"))
    return table(spark, sf, "documents").select("doc_id", name.alias("class"))


@query("set_union_all", "SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, 'labelled' FROM labels")
def set_union_all(spark, sf):
    return sampling.union_all(
        table(spark, sf, "documents").select("doc_id", "lang"),
        table(spark, sf, "labels").select(F.lit("labelled").alias("lang"), "doc_id"),
    )


@query(
    "sample_balanced_exact_n",
    f"""WITH {CLAIMS}, r AS (
          SELECT claim_id, label, row_number() OVER (PARTITION BY label ORDER BY claim_id) AS rn,
                 count(*) OVER (PARTITION BY label) AS size FROM claims WHERE label IS NOT NULL)
        SELECT claim_id, label FROM r WHERE rn <= 20 AND size >= 20""",
)
def sample_balanced_exact_n(spark, sf):
    return sampling.balanced_exact_n(claims(spark, sf).select("claim_id", "label"), "label", ["claim_id"], 20)


@query(
    "sample_singleton_classes",
    f"WITH {CLASSES} SELECT d.doc_id, d.class, (n.size = 1)::INT AS is_rare FROM d JOIN n ON d.class = n.class",
)
def sample_singleton_classes(spark, sf):
    rare, rest = sampling.rare_and_rest(classed(spark, sf), "class", 1)
    return sampling.union_all(rare.withColumn("is_rare", F.lit(1)), rest.withColumn("is_rare", F.lit(0)))


@query(
    "sample_oversample_rare",
    f"""WITH {CLASSES}, m AS (SELECT max(size) AS largest FROM n)
        SELECT d.doc_id, d.class, unnest(range(1, CASE WHEN n.size = 1 THEN m.largest ELSE 1 END + 1)) AS copy
        FROM d JOIN n ON d.class = n.class, m""",
)
def sample_oversample_rare(spark, sf):
    return sampling.oversample_rare(classed(spark, sf), "class", 1)


@query(
    "split_stratified",
    """WITH r AS (
         SELECT o_orderkey, o_orderpriority,
                row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS rn,
                count(*) OVER (PARTITION BY o_orderpriority) AS size FROM orders)
       SELECT o_orderkey, o_orderpriority, (rn <= ceil(0.2::DOUBLE * size))::INT AS is_test FROM r""",
)
def split_stratified(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.split_stratified(rows, "o_orderpriority", "o_orderkey", 0.2)


@query(
    "split_random",
    """SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10000 < 8000)::INT AS is_train FROM documents""",
)
def split_random(spark, sf):
    return sampling.split_random(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.8)


# --- features ---------------------------------------------------------------------------

BRAND_INDEX = """SELECT p_brand AS value, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS value_index, count(*) AS cnt
  FROM part GROUP BY p_brand"""
TYPE_INDEX = """SELECT p_type AS value, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS value_index, count(*) AS cnt
  FROM part GROUP BY p_type"""


@query(
    "feat_string_index",
    f"WITH b AS ({BRAND_INDEX}) SELECT p_partkey, p_brand, value_index AS brand_index FROM part JOIN b ON p_brand = value",
)
def feat_string_index(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    index = features.frequency_index(parts, "p_brand")
    return features.apply_index(parts, index, "p_brand", "brand_index", keep_unseen=False)


@query(
    "feat_label_encode",
    f"""WITH {CLAIMS}, i AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id
                             FROM (SELECT DISTINCT label FROM claims WHERE label <> 'Q0_T1'))
        SELECT c.claim_id, coalesce(i.label_id, -1) AS label_id, coalesce(i.label, 'none') AS decoded
        FROM claims c LEFT JOIN i ON c.label = i.label""",
)
def feat_label_encode(spark, sf):
    """Fit without one label, so that label is unseen when the index is applied."""
    rows = claims(spark, sf).select("claim_id", "label")
    index = features.label_index(rows.filter(F.col("label") != "Q0_T1"), "label")
    encoded = features.apply_index(rows, index, "label", "label_id", keep_unseen=True)
    decoded = features.decode_label(encoded, index, "label_id", "decoded")
    return decoded.select(
        "claim_id", F.coalesce("label_id", F.lit(-1)).alias("label_id"), F.coalesce("decoded", F.lit("none")).alias("decoded")
    )




@query(
    "feat_onehot",
    "SELECT doc_id, (lang = 'de')::INT AS lang_de, (lang = 'en')::INT AS lang_en, (lang = 'es')::INT AS lang_es, (lang = 'fr')::INT AS lang_fr FROM documents",
)
def feat_onehot(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    return features.onehot_columns(rows, "lang", features.onehot_values(rows, "lang")).drop("lang")


@query("feat_assemble_vector", "SELECT p_partkey, p_size::DOUBLE AS f0, p_retailprice AS f1, 2::BIGINT AS width FROM part")
def feat_assemble_vector(spark, sf):
    made = features.assemble_vector(table(spark, sf, "part"), ["p_size", "p_retailprice"])
    v = vector_to_array("features")
    return made.select("p_partkey", v[0].alias("f0"), v[1].alias("f1"), F.size(v).cast("long").alias("width"))


@query(
    "feat_pipeline",
    f"""WITH b AS ({BRAND_INDEX}), t AS ({TYPE_INDEX})
        SELECT p_partkey, p_size::DOUBLE AS f0, p_retailprice AS f1, b.value_index::DOUBLE AS f2, t.value_index::DOUBLE AS f3
        FROM part JOIN b ON p_brand = b.value JOIN t ON p_type = t.value""",
)
def feat_pipeline(spark, sf):
    parts = table(spark, sf, "part")
    made = features.feature_vectors(parts, ["p_size", "p_retailprice"], ["p_brand", "p_type"])
    v = vector_to_array("features")
    return made.select("p_partkey", *[v[i].alias(f"f{i}") for i in range(4)])


@query("feat_onehot_long", "SELECT doc_id, source AS value, 1 AS flag FROM documents WHERE source IS NOT NULL")
def feat_onehot_long(spark, sf):
    return features.onehot_long(table(spark, sf, "documents"), "doc_id", "source")


EXPLORED = ["miles", "code", "engine_indexed", "failcode_indexed"]
EXPLORED_SQL = DIRTY + """, usable AS (
  SELECT claim_id, engine, failcode, miles::DOUBLE AS miles, coalesce(TRY_CAST(code AS DOUBLE), 0) AS code FROM dirty
  WHERE label IS NOT NULL AND TRY_CAST(label AS DOUBLE) IS NULL AND NOT regexp_matches(label, '^[0-9]+$|[|]')),
e AS (SELECT engine, row_number() OVER (ORDER BY count(*) DESC, engine) - 1 AS engine_indexed FROM usable GROUP BY engine),
f AS (SELECT failcode, row_number() OVER (ORDER BY count(*) DESC, failcode) - 1 AS failcode_indexed FROM usable GROUP BY failcode),
x AS (SELECT * FROM usable JOIN e USING (engine) JOIN f USING (failcode))"""


@query(
    "explore_correlation",
    f"WITH {EXPLORED_SQL} " + " UNION ALL ".join(
        f"SELECT '{EXPLORED[i]}' AS feature_a, '{EXPLORED[j]}' AS feature_b, round(corr({EXPLORED[i]}, {EXPLORED[j]}), 6) AS r FROM x"
        for i in range(len(EXPLORED))
        for j in range(i)
    ),
)
def explore_correlation(spark, sf):
    """The exploration chain: usable labels, cast codes, filled gaps, indexed categories, correlation of all of them."""
    rows = dirty_claims(spark, sf).withColumn("label", cleanse.normalize_label("label"))
    numeric = cleanse.cast_numeric(cleanse.labelled(rows, "label"), ["miles", "code"])
    filled = cleanse.fill_missing(numeric.select("claim_id", "engine", "failcode", "miles", "code"), "code")
    indexed = written(features.indexed_categories(filled, ["engine", "failcode"]), "explored")
    matrix = aggregates.correlation_matrix(indexed, EXPLORED)
    return aggregates.correlation_pairs(matrix, EXPLORED).withColumn("r", F.round("r", 6))
