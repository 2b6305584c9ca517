"""Scalar functions over text, JSON and small numeric arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\r"
BLANK_RUN = r"[ \t\n\r]+"


def clean_text(text: str) -> Column:
    """Newlines removed, and the blank before a full stop."""
    return F.regexp_replace(F.regexp_replace(F.col(text), "\n", ""), r" ?\.", ".")


def tokens(text: Column) -> Column:
    """Blank-separated tokens; an empty text has none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def concat_codes(columns: Sequence[str]) -> Column:
    """Codes joined by commas, NULLs skipped; all NULL gives the empty string."""
    return F.concat_ws(",", *[F.col(c).cast("string") for c in columns])


def template_text(prefix: str, text: str, suffix: str) -> Column:
    return F.concat(F.lit(prefix), F.col(text), F.lit(suffix))


def struct_to_text(df: DataFrame, column: str) -> Column:
    """Field values joined by a blank; missing values are skipped."""
    fields = df.schema[column].dataType.fieldNames()
    return F.concat_ws(" ", *[F.col(f"{column}.{f}").cast("string") for f in fields])


def json_fields(df: DataFrame, column: str, fields: T.StructType) -> DataFrame:
    """Parse lower-cased JSON and expose its fields; ``fields`` uses lower-case names."""
    parsed = df.withColumn("_json", F.from_json(F.lower(F.col(column)), fields))
    return parsed.select(*df.columns, *[F.col(f"_json.{f}").alias(f) for f in fields.fieldNames()])


def records_to_json(df: DataFrame, out: str = "record") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def probability_percent(column: str) -> Column:
    """``"[0.81]"`` -> ``81.0``; text that does not parse gives NULL."""
    inner = F.expr(f"substring(`{column}`, 2, length(`{column}`) - 2)")
    return inner.try_cast("double") * F.lit(100.0)


def truncate_tokens(text: str, limit: int = 512) -> tuple[Column, Column]:
    """(first ``limit`` tokens as text, whether anything was cut)."""
    parts = tokens(F.col(text))
    return F.array_join(F.slice(parts, 1, limit), " "), F.size(parts) > limit


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, summed in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def rerank_dot_score(a: Column, b: Column) -> Column:
    """Dot product cut to an integer, which makes ties likely."""
    return dot(a, b).cast("int")


def softmax_argmax(logits: str) -> Column:
    """struct(probabilities, probability, prediction); ties take the lowest index."""
    value = F.col(logits)
    shifted = F.transform(
        F.array(value),
        lambda v: F.transform(v, lambda x: F.exp(x.cast("double") - F.array_max(v).cast("double"))),
    )[0]
    normal = F.transform(
        F.array(shifted),
        lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda acc, y: acc + y)),
    )[0]
    return F.struct(
        normal.alias("probabilities"),
        F.array_max(normal).alias("probability"),
        (F.array_position(value, F.array_max(value)) - 1).cast("int").alias("prediction"),
    )
