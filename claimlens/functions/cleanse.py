"""Row filters, label clean-up and casts. All keep work inside generated code."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label that stands for "no label", and what never is a label.
NOT_INSPECTED = "Not Inspected"
NON_LABEL_PATTERN = r"^\d+$|\|"

LITERAL_LIST_LIMIT = 1_000


def parses_as_double(name: str) -> Column:
    return F.col(name).try_cast("double").isNotNull()


def keep_null_or_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows in which each column is NULL or parses as a number."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNull() | parses_as_double(c) for c in columns]))


def null_label_to_sentinel(label: str) -> Column:
    return F.coalesce(F.col(label), F.lit(NOT_INSPECTED))


def numeric_label_to_sentinel(label: str) -> Column:
    return F.when(parses_as_double(label), NOT_INSPECTED).otherwise(F.col(label))


def pattern_label_to_sentinel(label: str) -> Column:
    return F.when(F.col(label).rlike(NON_LABEL_PATTERN), NOT_INSPECTED).otherwise(F.col(label))


def normalize_label(label: str) -> Column:
    """NULL, numeric and digits-or-pipe labels all become the sentinel."""
    unusable = F.col(label).isNull() | parses_as_double(label) | F.col(label).rlike(NON_LABEL_PATTERN)
    return F.when(unusable, NOT_INSPECTED).otherwise(F.col(label))


def cast_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Cast to double in one projection; text that does not parse becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def fill_missing(df: DataFrame, name_part: str = "FC") -> DataFrame:
    """Zero for NULL in numeric columns, first where the name holds ``name_part``.

    String columns are left as they are."""
    chosen = [c for c in df.columns if name_part in c]
    return (df.fillna(0, subset=chosen) if chosen else df).fillna(0)


def labelled(df: DataFrame, label: str) -> DataFrame:
    """Rows with a usable label; a NULL label goes too."""
    return df.filter(F.col(label) != F.lit(NOT_INSPECTED))


def unlabelled(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label) == F.lit(NOT_INSPECTED))


def drop_labels(df: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    """Rows whose label is not listed, as in ``NOT IN``: a NULL label goes too, and a NULL in the list leaves no row.

    A long list is joined instead of written into the plan, with the same result."""
    if any(v is None for v in labels):
        return df.filter(F.lit(False))
    if len(labels) <= LITERAL_LIST_LIMIT:
        return df.filter(~F.col(label).isin(*labels))
    from claimlens.session import small_side

    listed = df.sparkSession.createDataFrame([(v,) for v in labels], f"`{label}` string")
    return df.filter(F.col(label).isNotNull()).join(small_side(listed, computed=True), label, "left_anti")


def rows_of_key(df: DataFrame, key: str, value) -> DataFrame:
    """All rows of one key; the key need not be unique."""
    return df.filter(F.col(key) == F.lit(value))


def first_with_prefix(df: DataFrame, text: str, prefix: str, order_by: str) -> DataFrame:
    """The first row in key order whose text starts with ``prefix``."""
    return df.filter(F.col(text).startswith(prefix)).orderBy(order_by).limit(1)
