"""From raw documents to a training mix: five stages, each written to the shared folder and read again.

Every stage takes (spark, docs, sf_dir) and decides over all documents that the stage before it kept.
All but the last return the columns of ``documents``, in that order; further columns of the input are left behind, whatever their names.
An empty table passes every stage as an empty table; rows that repeat are judged each, unless a stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimlens.llm.decontaminate import without_leaks
from claimlens.llm.mixture import mix
from claimlens.llm.ngram_join import one_of_each
from claimlens.llm.pii import redact
from claimlens.llm.quality import keep_good, train
from claimlens.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go. It learns from the labels outside the held-out part.

    A missing text is judged as an empty one; a row without id is judged like any other. Without usable labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, train(docs, labels)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles at similarity 0.8 the lowest id stays.

    Missing, empty and blank texts link with nothing and stay, as do rows without id; rows that repeat an id stay or go together."""
    return one_of_each(docs, n=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or re-parameterised, go.

    Missing and empty texts hold nothing and stay, as do rows without id; an empty benchmark takes nothing."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in angle brackets; every document stays.

    A missing text stays missing, and ``n_chars`` changes only where the text does."""
    return redact(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size, their source's size and target, and the words taken of each.

    Missing and empty texts have no words and so are never taken; a null source is a source of its own."""
    return mix(docs, carry=COLUMNS).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

# The classifier and the joins have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
