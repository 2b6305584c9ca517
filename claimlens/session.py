"""Session helpers: shared scratch folder, input spreading, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits for a side that may be broadcast; both are checked before the hint is given.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024

_fallback_dirs: dict[str, str] = {}


def local_session(cores: str = "8", memory: str = "8g", shuffle_partitions: str = "8") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster bring your own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("claimlens")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        # Small local inputs: keep a few hundred kilobytes of rows on all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where the cluster names one,
    else the context's own checkpoint folder, else (on one machine only) a fresh temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = own.get() if own.isDefined() else None
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="claimlens-")
    return _fallback_dirs[app]


def session_dir(spark: SparkSession) -> str:
    """Where this session's scratch tables lie: one folder, so that it can be removed as a whole."""
    return f"{shared_dir(spark)}/claimlens/{spark.sparkContext.applicationId}"


def remove_scratch(spark: SparkSession) -> None:
    """Remove the session's scratch tables; results that are still lazy cannot be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{session_dir(spark)}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Even out a CPU-heavy narrow stage over a scan with fewer splits than there are cores.

    A large table has more splits than cores and passes through without a shuffle. Give it
    scans only: asking a frame that holds a shuffle for its partitions would run that shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES, computed: bool = False) -> DataFrame:
    """A join side with a broadcast hint if a count proves it small, without one if not.

    No more than ``rows`` + 1 rows are ever written: if that is all there is, this copy is the side
    that gets broadcast, so a costly aggregate does not run again for the join. A larger side
    stays lazy: the join shuffles, and adaptive execution splits its skewed keys.
    ``computed`` says that the side is stored or literal already."""
    side = df if computed else written(df.limit(rows + 1), "side")
    seen = (
        side.limit(rows + 1)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*side.columns)))), F.lit(0)).alias("b"),
        )
        .first()
    )
    return F.broadcast(side) if seen["n"] <= rows and seen["b"] <= size else df
