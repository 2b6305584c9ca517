"""An index of embedded rows that follows its source: new, changed and deleted rows, switched version by version.

An index is a folder of segments (Parquet), lists of dead rows, and manifests. A refresh compares keys and content hashes, embeds
only what is new or changed into one new segment, notes what it replaces as dead, and at last puts the manifest of the next
version in place by one rename. A reader opens the highest manifest, so it sees a refresh whole or not at all, and a refresh that
breaks off leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.session import small_side, written

# Dead rows beyond this share of the stored ones: the refresh writes the living rows anew.
COMPACT_SHARE = 0.3
HASH, VERSION = "_hash", "_version"


def content_hash(columns: Sequence[str]) -> Column:
    """md5 of the columns as JSON; NULLs are told apart from empty texts."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest version's manifest; version 0 is an index without rows."""
    files, folder = _files(spark, f"{path}/manifests")
    if not files.exists(folder):
        return {"version": 0, "segments": [], "dead": [], "rows": 0, "dead_rows": 0}
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    newest = max((n for n in names if n.endswith(".json")), default=None)
    if newest is None:
        return {"version": 0, "segments": [], "dead": [], "rows": 0, "dead_rows": 0}
    return json.loads(spark.read.text(f"{path}/manifests/{newest}").first()[0])


def _switch(spark: SparkSession, path: str, content: dict) -> None:
    """Put a manifest in place: written aside, then renamed. Fails if that version exists already: another refresh was faster."""
    files, folder = _files(spark, f"{path}/manifests")
    files.mkdirs(folder)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    aside = make(f"{path}/manifests/.{uuid.uuid4().hex}.tmp")
    final = make(f"{path}/manifests/{content['version']:012d}.json")
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if files.exists(final) or not files.rename(aside, final):
        files.delete(aside, False)
        raise RuntimeError(f"version {content['version']} of {path} was written by another refresh")


def _living(spark: SparkSession, path: str, state: dict) -> DataFrame:
    stored = spark.read.option("mergeSchema", "true").parquet(*[f"{path}/{s}" for s in state["segments"]])
    if not state["dead"]:
        return stored
    dead = spark.read.parquet(*[f"{path}/{d}" for d in state["dead"]])
    key = dead.columns[0]
    return stored.join(small_side(dead, computed=True), [key, VERSION], "left_anti")


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index's rows as of its newest version; None before the first refresh."""
    state = manifest(spark, path)
    return _living(spark, path, state).drop(HASH, VERSION) if state["segments"] else None


def refresh_index(
    path: str,
    source: DataFrame,
    key: str,
    embed: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    *,
    deletions: bool = True,
    compact_share: float = COMPACT_SHARE,
) -> dict[str, int]:
    """Bring the index at ``path`` in line with ``source``; creates it if absent. Returns rows added, changed, deleted, embedded.

    Only keys and hashes are compared; texts move for new and changed rows alone, and while those are few they are picked out
    of the source without a shuffle. ``deletions`` says whether a row that the source lacks leaves the index (False for a
    source that holds new rows only). Rows without a key are left out; of rows that repeat a key the one of lowest hash counts.
    A call that finds nothing to do writes no version."""
    spark = source.sparkSession
    state = manifest(spark, path)
    columns = source.columns
    hashed = source.where(F.col(key).isNotNull()).withColumn(HASH, content_hash(columns))
    wanted = hashed.groupBy(key).agg(F.min(HASH).alias(HASH))
    if state["segments"]:
        known = _living(spark, path, state).select(key, F.col(HASH).alias("_old"), VERSION)
        compared = wanted.join(known, key, "full")
    else:
        compared = wanted.withColumns({"_old": F.lit(None).cast("string"), VERSION: F.lit(None).cast("long")})
    kind = F.when(F.col("_old").isNull(), "added").when(F.col(HASH).isNull(), "deleted").when(F.col(HASH) != F.col("_old"), "changed")
    changes = written(compared.withColumn("kind", kind).where("kind is not null" if deletions else "kind in ('added', 'changed')"), "changes")
    counts = {r["kind"]: r["n"] for r in changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = {k: counts.get(k, 0) for k in ("added", "changed", "deleted")}
    fresh_rows, gone = found["added"] + found["changed"], found["changed"] + found["deleted"]
    if not fresh_rows + gone:
        return found | {"embedded": 0}
    version = state["version"] + 1
    content = {
        "version": version, "segments": list(state["segments"]), "dead": list(state["dead"]),
        "rows": state["rows"] + fresh_rows, "dead_rows": state["dead_rows"] + gone,
    }
    embedded = 0
    if fresh_rows:
        picked = changes.where("kind <> 'deleted'").select(key, HASH)
        # Several equal rows of one key hash alike: one of them is taken.
        rows = hashed.join(small_side(picked, computed=True), [key, HASH], "left_semi").dropDuplicates([key])
        segment = f"segments/{version:012d}-{uuid.uuid4().hex}"
        embed(rows).withColumn(VERSION, F.lit(version).cast("long")).write.parquet(f"{path}/{segment}")
        content["segments"].append(segment)
        embedded = spark.read.parquet(f"{path}/{segment}").count()
    if gone:
        dead = f"dead/{version:012d}-{uuid.uuid4().hex}"
        changes.where("kind <> 'added'").select(key, VERSION).write.parquet(f"{path}/{dead}")
        content["dead"].append(dead)
    if content["dead_rows"] > compact_share * content["rows"]:
        segment = f"segments/{version:012d}-{uuid.uuid4().hex}"
        _living(spark, path, content).write.parquet(f"{path}/{segment}")
        content |= {"segments": [segment], "dead": [], "rows": content["rows"] - content["dead_rows"], "dead_rows": 0}
    _switch(spark, path, content)
    return found | {"embedded": embedded}
