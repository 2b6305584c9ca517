"""Category indexes, one-hot columns, feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators.windows import ranked_rows
from claimlens.session import small_side, written


def frequency_index(df: DataFrame, column: str) -> DataFrame:
    """(value, value_index, cnt): most frequent first, ties alphabetical, NULL left out."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))
    counts = written(counts, "counts")
    ranked = ranked_rows(counts.withColumn("_neg", -F.col("cnt")), [], ["_neg", column], "_rn")
    return ranked.select(F.col(column).alias("value"), (F.col("_rn") - 1).alias("value_index"), "cnt")


def label_index(df: DataFrame, column: str) -> DataFrame:
    """(value, value_index) in alphabetical order, NULL left out."""
    values = written(df.filter(F.col(column).isNotNull()).select(column).distinct(), "values")
    ranked = ranked_rows(values, [], [column], "_rn")
    return ranked.select(F.col(column).alias("value"), (F.col("_rn") - 1).alias("value_index"))


def apply_index(df: DataFrame, index: DataFrame, column: str, out: str, keep_unseen: bool) -> DataFrame:
    """Put the index beside its column. Unseen values give NULL, or drop the row."""
    mapping = index.select(F.col("value").alias(column), F.col("value_index").alias(out))
    return df.join(small_side(mapping), column, "left" if keep_unseen else "inner")


def decode_label(df: DataFrame, index: DataFrame, column: str, out: str) -> DataFrame:
    mapping = index.select(F.col("value_index").alias(column), F.col("value").alias(out))
    return df.join(small_side(mapping), column, "left")


def onehot_values(df: DataFrame, column: str, most: int = 1_000) -> list:
    """The distinct values in order; more than ``most`` is an error, since each becomes a column."""
    rows = df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values")
    return [r[0] for r in rows]


def onehot_columns(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One 0/1 column per listed value, all levels kept; NULL is 0 everywhere."""
    flags = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}
    return df.withColumns(flags)


def assemble_vector(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """One dense vector per row; a NULL is an error, so fill missing values first."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


def onehot_long(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, value, flag): one row per row that holds a value, for any number of values; zeros are left out."""
    return df.filter(F.col(column).isNotNull()).select(key, F.col(column).alias("value"), F.lit(1).alias("flag"))


def indexed_categories(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """``<category>_indexed`` beside every category, by frequency; rows with a NULL one are left out.

    Indexes are tables that meet the rows in joins, so their values never pass the driver."""
    for c in categories:
        df = apply_index(df, frequency_index(df, c), c, f"{c}_indexed", keep_unseen=False)
    return df


def feature_vectors(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], out: str = "features") -> DataFrame:
    """Numbers and indexed categories in one vector per row."""
    return assemble_vector(indexed_categories(df, categories), [*numbers, *[f"{c}_indexed" for c in categories]], out)
