"""Table and file writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _writer(df: DataFrame, mode: str, path: str | None):
    writer = df.write.format("parquet").mode(mode)
    return writer.option("path", path) if path else writer


def append_table(df: DataFrame, table: str, path: str | None = None) -> None:
    _writer(df, "append", path).saveAsTable(table)


def overwrite_table(df: DataFrame, table: str, path: str | None = None) -> None:
    """Replace rows and schema. ``df`` must not read the table it replaces."""
    _writer(df, "overwrite", path).option("overwriteSchema", True).saveAsTable(table)


def create_table_if_absent(
    spark: SparkSession, table: str, build: Callable[[], DataFrame], path: str | None = None
) -> bool:
    """Create ``table`` from ``build()`` unless it exists; true when it was created."""
    if spark.catalog.tableExists(table):
        return False
    _writer(build(), "errorifexists", path).saveAsTable(table)
    return True


def write_csv(df: DataFrame, path: str) -> None:
    """Headered CSV, quotes doubled inside quoted values; no row index is written."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
