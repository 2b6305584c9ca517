"""The given tables seen as claims, and the SQL text of the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators.search import topk
from claimlens.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A document is a claim: source = engine, language = fail code, text = narrative."""
    facts = labels.select("doc_id", F.concat(F.lit("Q"), "quality", F.lit("_T"), "toxic").alias("label"))
    return documents.join(facts, "doc_id", "left").select(
        F.col("doc_id").alias("claim_id"),
        F.col("source").alias("engine"),
        F.col("lang").alias("failcode"),
        F.col("n_chars").alias("miles"),
        F.col("text").alias("narrative"),
        "label",
    )


def plain_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims for work that asks for no label: the labels are not joined."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("claim_id"), F.col("source").alias("engine"), F.col("lang").alias("failcode"), F.col("n_chars").alias("miles"), F.col("text").alias("narrative"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def spread_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims for work that is heavy per text."""
    return claims_of(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


CLAIMS = """claims AS (
  SELECT d.doc_id AS claim_id, d.source AS engine, d.lang AS failcode, d.n_chars AS miles, d.text AS narrative,
         CASE WHEN l.doc_id IS NULL THEN NULL ELSE concat('Q', l.quality, '_T', l.toxic) END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def dirty_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose label and code carry what raw files carry: NULLs, numbers, pipes, words."""
    c = claims(spark, sf_dir)
    label = (
        F.when(F.col("claim_id") % 11 == 0, F.col("miles").cast("string"))
        .when(F.col("claim_id") % 13 == 0, F.concat(F.lit("A|"), F.col("engine")))
        .otherwise(F.col("label"))
    )
    code = F.when(F.col("claim_id") % 7 == 0, None).when(F.col("claim_id") % 5 == 0, F.col("failcode")).otherwise(
        F.col("miles").cast("string")
    )
    return c.withColumns({"label": label, "code": code})


DIRTY = CLAIMS + """, dirty AS (
  SELECT claim_id, engine, failcode, miles, narrative,
         CASE WHEN claim_id % 11 = 0 THEN CAST(miles AS VARCHAR) WHEN claim_id % 13 = 0 THEN concat('A|', engine)
              ELSE label END AS label,
         CASE WHEN claim_id % 7 = 0 THEN NULL WHEN claim_id % 5 = 0 THEN failcode ELSE CAST(miles AS VARCHAR) END AS code
  FROM claims)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "claim_id")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "query_id")


def vector_hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Every vector searched among all the others."""
    return topk(vector_queries(spark, sf_dir), vectors(spark, sf_dir), k)


def hits_sql(name: str = "hits", k: int = 10, where: str = "true", vector: str = "embedding::DOUBLE[]") -> str:
    return f"""{name} AS (
  SELECT query_id, claim_id, score, rank FROM (
    SELECT query_id, claim_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS rank
    FROM (SELECT q.vec_id AS query_id, v.vec_id AS claim_id, round(list_inner_product(q.e, v.e), 9) AS score
          FROM (SELECT vec_id, {vector} AS e FROM embeddings) q,
               (SELECT vec_id, label, {vector} AS e FROM embeddings) v
          WHERE q.vec_id <> v.vec_id AND {where}))
  WHERE rank <= {k})"""


HITS = hits_sql()

# Blank-separated tokens of whole texts.
TOKENS_OF = r"list_filter(regexp_split_to_array(trim({text}, E' \t\n\r'), '[ \t\n\r]+'), lambda t: t <> '')"


def tokens_sql(text: str) -> str:
    return TOKENS_OF.replace("{text}", text)


def embedding_sql(name: str, table_sql: str, key: str, text: str, dimensions: int) -> str:
    """CTEs up to ``name`` (key, dim, w): unit-length hashed weights, zero entries left out."""
    return f"""{name}_tokens AS (SELECT {key}, md5(unnest({tokens_sql(f'lower({text})')})) AS m FROM {table_sql}),
{name}_sums AS (
  SELECT {key}, ('0x' || substr(m, 1, 8))::BIGINT % {dimensions} AS dim,
         sum(CASE WHEN ('0x' || substr(m, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS c
  FROM {name}_tokens GROUP BY ALL),
{name} AS (
  SELECT {key}, dim, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS w FROM {name}_sums WHERE c <> 0)"""
