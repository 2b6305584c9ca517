"""The registered queries of the corpus operators, each with its SQL check where SQL can state the result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm.decontaminate import contaminated
from claimlens.llm.mixture import mix
from claimlens.llm.negatives import hard_negatives
from claimlens.llm.ngram_join import ngram_components
from claimlens.llm.packing import pack
from claimlens.llm.passages import repeated_passages
from claimlens.llm.pii import digest, find
from claimlens.llm.quality import quality_scores, train as train_quality
from claimlens.llm.repetition import DUPLICATE_GRAMS, DUPLICATE_LINES, repetition_rules
from claimlens.llm.token_count import read_vocabulary, token_counts
from claimlens.llm.toxicity import toxicity_scores, train as train_toxicity
from claimlens.llm.turns import repaired
from claimlens.llm.url_filter import canonical, host, judge_urls, path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


VOCABULARY = os.environ.get("CLAIMLENS_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")

WORDS_SQL = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS_SQL.format(text='text')})::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2 AS most
  FROM totals),
stepped AS (
  SELECT *, row_number() OVER w AS position,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM ranked WINDOW w AS (ORDER BY most / weight, source NULLS LAST)),
levelled AS (
  SELECT *, (SELECT arg_min(level, position) FROM stepped WHERE level <= most / weight) AS common FROM stepped),
aimed AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce(common * weight, most::DOUBLE)) AS target FROM levelled),
budgets AS (
  SELECT *, floor(target)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs
  FROM aimed),
placed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - earlier)))::BIGINT AS taken
FROM placed"""


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text under the unigram segmentation of a public vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), read_vocabulary(VOCABULARY))


# Fixed values of the contract.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
# Pages of these hosts give the listed URLs.
SPAM_HOST = r"(^|\.)spam[^.]*\."

URLS_SQL = rf"""
WITH judged AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
plain AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canonical,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM judged),
listed AS (SELECT DISTINCT canonical FROM plain WHERE regexp_matches(host, '{SPAM_HOST}'))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM plain"""


@query("op4_url_filter", URLS_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against five rules and the list of canonical URLs of spam hosts."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    spam = pages.where(host("url").rlike(SPAM_HOST))
    return judge_urls(pages, rules, spam.select(canonical(host("url"), path("url")).alias("url")))


@query("op5_mix_sources", MIX_SQL)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source weight: 150 % of all words, no source beyond twice its size."""
    return mix(table(spark, sf_dir, "documents"))


def _repeats_sql(n: int) -> str:
    return f"""
win{n} AS (
  SELECT rid, p, hash(string_agg(word, ' ') OVER g) AS gram, count(*) OVER g AS wide
  FROM tok WINDOW g AS (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)),
twice{n} AS (
  SELECT rid, p, nth > 1 AS later
  FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS found, row_number() OVER (PARTITION BY rid, gram ORDER BY p) AS nth
        FROM win{n} WHERE wide = {n}) WHERE found > 1),
cov{n} AS (
  SELECT rid, count(*) AS words_in, coalesce(sum(size) FILTER (WHERE later), 0) AS chars_in
  FROM (SELECT rid, p + o AS p, bool_or(later) AS later FROM twice{n}, (SELECT unnest(range(0, {n})) AS o) GROUP BY ALL) JOIN tok USING (rid, p)
  GROUP BY rid)"""


REPETITION_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS_SQL.format(text='text')} AS words FROM documents),
tok AS (SELECT rid, word, p, len(word) AS size FROM (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w)),
lines AS (
  SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY i) AS seen
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM w)),
again AS (
  SELECT rid, count(*) AS n, sum(len(array_to_string({WORDS_SQL.format(text='line')}, ''))) AS chars
  FROM lines WHERE seen > 1 AND len({WORDS_SQL.format(text='line')}) > 0 GROUP BY rid),{','.join(_repeats_sql(n) for n in DUPLICATE_GRAMS)},
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(again.n, 0)::BIGINT AS n_dup_lines, coalesce(cov5.words_in, 0)::BIGINT AS n_repeat_words,
         coalesce(again.chars::DOUBLE / len(array_to_string(words, '')), 0) AS line_share,
         {', '.join(f"coalesce(cov{n}.chars_in::DOUBLE / len(array_to_string(words, '')), 0) AS share_{n}" for n in DUPLICATE_GRAMS)}
  FROM w LEFT JOIN again USING (rid) {' '.join(f'LEFT JOIN cov{n} USING (rid)' for n in DUPLICATE_GRAMS)})
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND line_share <= {DUPLICATE_LINES}
       AND {' AND '.join(f'share_{n} <= {most}' for n, most in DUPLICATE_GRAMS.items())} AS kept
FROM m"""


@query("op9_repetition_rules", REPETITION_SQL)
def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures of every document, and whether it is kept."""
    return repetition_rules(table(spark, sf_dir, "documents"))


@query("op10_ngram_jaccard_join")
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 4-word shingle sets of Jaccard similarity 0.85 or more."""
    return ngram_components(table(spark, sf_dir, "documents"), n=4, percent=85)


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by a rule ensemble trained on the labels outside the held-out part."""
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train_quality(docs, table(spark, sf_dir, "labels")))


@query("op3_toxicity_decoded")
def op3_toxicity_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity after undoing disguised spelling."""
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


@query("op6_contextual_pii")
def op6_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base entities and identifiers found through their contexts."""
    return digest(find(table(spark, sf_dir, "documents")))


@query("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers, names or units."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_repeated_passages")
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document shares with an earlier one."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def packing_vocabulary() -> str:
    """The byte-level tokenizer file's JSON."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@query("op11_concat_and_cut")
def op11_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents end to end as token ids, cut into sequences of 1024."""
    return pack(table(spark, sf_dir, "documents"), packing_vocabulary(), digest=True)


NEGATIVES_SQL = """
WITH taking AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM taking a JOIN taking b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 3"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every 50th vector and its nearest of the same label, the best vectors of other labels with half to 95 % of that score."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = (
        table(spark, sf_dir, "embeddings")
        .where(finite)
        .select(
            F.col("vec_id").alias("id"),
            moved.cast("long").alias("label"),
            F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"),
        )
    )
    return hard_negatives(rows, rows.where(F.col("id") % 50 == 0))


TURNS_SQL = r"""
WITH RECURSIVE crc AS (SELECT [list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), n) FOR n IN range(256)] AS tab),
keyed AS (SELECT *, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS key FROM conversations),
dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([ascii(key[i]) FOR i IN range(1, len(key) + 1)], lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS code
  FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, copy,
         CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM dealt WHERE code <> 0)),
solid AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS solid, role[1] AS initial FROM damaged),
marked AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, lag(initial) OVER w AS before,
         CASE WHEN solid = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 2
              WHEN solid[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM solid WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
steps AS (
  SELECT conv_id, n AS i, {'c': 0, 'a': ''} AS s, {'c': 10, 'a': 'II'} AS m, {'c': 0, 'a': ''} AS u, {'c': 5, 'a': 'I'} AS a FROM marked GROUP BY ALL
  UNION ALL
  SELECT conv_id, i - 1, least(bs, {'c': 5 + ia.c, 'a': 'I' || ia.a}), least(bm, {'c': 5 + ia.c, 'a': 'I' || ia.a}), least(bu, {'c': 5 + ba.c, 'a': 'I' || ba.a}), ia
  FROM (SELECT *, least(ba, {'c': 5 + bu.c, 'a': 'I' || bu.a}) AS ia
        FROM (SELECT x.conv_id, x.i,
                     least({'c': 2 + s.c, 'a': 'D' || s.a}, {'c': gone + to_u + a.c, 'a': ku || a.a}, {'c': gone + CASE WHEN initial = 's' THEN 0 ELSE 99999 END + m.c, 'a': 'K' || m.a}) AS bs,
                     least({'c': 2 + m.c, 'a': 'D' || m.a}, {'c': gone + to_u + a.c, 'a': ku || a.a}) AS bm,
                     least({'c': 2 + u.c, 'a': 'D' || u.a}, {'c': gone + to_u + a.c, 'a': ku || a.a}) AS bu,
                     least({'c': 2 + a.c, 'a': 'D' || a.a}, {'c': gone + to_a + u.c, 'a': ka || u.a}) AS ba
              FROM steps x JOIN (
                SELECT conv_id, i, initial, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 99999 END AS gone,
                       (initial <> 'u')::INT AS to_u, (initial <> 'a')::INT AS to_a,
                       CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END AS ku, CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END AS ka FROM marked) r
                ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i))),
cheapest AS (SELECT conv_id, s.c AS cost, s.a AS audit FROM steps WHERE i = 0),
edits AS (
  SELECT conv_id, p, audit[p] AS edit, len(replace(audit[:p], 'I', '')) AS i FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS p FROM cheapest)),
placed AS (
  SELECT e.conv_id, p, edit, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, edit <> 'D' AND NOT (edit = 'K' AND initial = 's') AS counts
  FROM edits e LEFT JOIN marked r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i),
lines AS (
  SELECT conv_id, p, CASE WHEN edit = 'K' THEN role WHEN count(*) FILTER (counts) OVER (PARTITION BY conv_id ORDER BY p) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text AS line
  FROM placed QUALIFY edit <> 'D'),
repaired AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS digest FROM lines GROUP BY conv_id),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate,
         count_if(fault = 3) AS truncated, count_if(i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN cheapest c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query("op13_repair_turns", TURNS_SQL)
def op13_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by the contract's rule, its faults, its cheapest repair and that repair's digest."""
    return repaired(table(spark, sf_dir, "conversations"))
