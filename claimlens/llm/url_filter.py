"""URL lists: a blocked Bloom filter passes possible hits, and an exact hash join removes the false ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import UPPER
from claimlens.session import written

# A block is 8 words of 32 bits; a key sets one bit in each.
LANES = 8
BITS_PER_KEY = 12
# Largest filter: bounds what is broadcast to about 10 MB; a longer list only lets more false hits reach the join.
MAX_BLOCKS = 1 << 17

PREFIX, WHOLE = "p ", "u "


def host(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, UPPER, UPPER.lower())


def path(url: str) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host_name: Column, path_name: Column) -> Column:
    """One spelling per page: no scheme, leading www., query, fragment or closing slashes."""
    return F.concat(F.regexp_replace(host_name, r"^www\.", ""), F.regexp_replace(path_name, "/+$", ""))


def bits(key: str) -> list[Column]:
    """The bit of each lane, as a one-bit number."""
    hashed = F.xxhash64(F.col(key), F.lit("lanes"))
    places = [F.shiftright(hashed, 5 * i).bitwiseAND(F.lit(31)).cast("int") for i in range(LANES)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter of a table of ``key``; at most ``blocks`` rows."""
    lanes = keys.select(
        F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits("key"))]
    )
    return lanes.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(LANES)])


def possible(rows: DataFrame, filtered: DataFrame, blocks: int) -> DataFrame:
    """The rows whose ``key`` may be in the filter. The filter has at most ``blocks`` rows, so it is broadcast."""
    probing = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    hit = F.lit(True)
    for i, bit in enumerate(bits("key")):
        hit &= F.col(f"w{i}").bitwiseAND(bit) != 0
    return probing.join(F.broadcast(filtered), "block").where(hit).drop("block", *[f"w{i}" for i in range(LANES)])


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """Per page: page_id, host, path, rule (host and path of the longest rule that fits, else null), verdict.

    ``rules`` (host, path, verdict) fit a host and all its subdomains where the page's path starts with
    the rule's; without a rule, a page is blocked if its canonical URL is in ``listed`` (url,
    canonical form), else allowed. Every distinct URL offers its keys - each domain above its host
    with each path prefix of a length that rules have, and its canonical form - to the Bloom
    filter of rules and list together; what passes is joined exactly with rules and list.

    A null URL, or one without ``://``, has empty host and path, fits no rule and is allowed. Repeated
    pages are judged each; of rules with equal host and path the one that blocks wins; empty tables
    are allowed on every side; further columns are ignored."""
    narrow = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    ruled = rules.select(
        F.concat(F.lit(PREFIX), "host", "path").alias("key"),
        F.col("verdict").alias("listed_verdict"),
        F.concat("host", "path").alias("rule"),
        F.length("path").alias("path_length"),
    )
    whole = listed.select(F.concat(F.lit(WHOLE), "url").alias("key"), F.lit("block").alias("listed_verdict"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("path_length"))
    entries = written(
        ruled.unionByName(whole).where("key is not null").groupBy("key", "rule", "path_length").agg(F.max("listed_verdict").alias("listed_verdict")),
        "entries",
    )
    facts = entries.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(F.col("rule").isNotNull(), F.col("path_length")))).alias("lengths")).first()
    blocks = max(1, min(max_blocks, math.ceil(facts["n"] * BITS_PER_KEY / (32 * LANES))))
    # The domains above a host, itself first, then every prefix length that some rule has.
    lengths = F.array(*[F.lit(n) for n in facts["lengths"]]) if facts["lengths"] else F.array().cast("array<int>")
    parts = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    fitting = F.filter(lengths, lambda n: n <= F.length("path"))
    prefixes = F.flatten(
        F.transform(domains, lambda d: F.transform(fitting, lambda n: F.concat(F.lit(PREFIX), d, F.substring(F.col("path"), F.lit(1), n))))
    )
    keys = F.array_union(prefixes, F.array(F.concat(F.lit(WHOLE), canonical(F.col("host"), F.col("path")))))
    urls = narrow.where(F.instr("url", "://") > 0).select("url").distinct()
    offered = urls.withColumns({"host": host("url"), "path": path("url")}).select("url", F.explode(keys).alias("key"))
    passed = possible(offered, bloom(entries, blocks), blocks)
    exact = passed.join(entries.hint("shuffle_hash"), "key")
    # The longest rule; a listed URL counts where no rule fits.
    hits = written(
        exact.groupBy("url").agg(F.max(F.struct(F.coalesce(F.length("rule"), F.lit(-1)).alias("size"), "rule", "listed_verdict")).alias("hit")).select("url", "hit.rule", "hit.listed_verdict"),
        "url_hits",
    )
    found = narrow.join(hits.withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left")
    return found.select(
        "page_id", host("url").alias("host"), path("url").alias("path"), "rule", F.coalesce("listed_verdict", F.lit("allow")).alias("verdict")
    )
