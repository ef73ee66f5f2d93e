"""Corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing, BPE encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's ``docs``. The first four return rows with the columns of ``documents``; the last
one returns the encoded rows. Null texts never pass the first stage; an empty table passes through
all stages as no rows; repeated rows are one row after the second stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loadscope.llm import bpe, exact_dedup, language_id, mixing, near_dup
from loadscope.llm.common import saved, with_package
from loadscope.llm.queries import tokenizer_path
from loadscope.sources.tables import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language that the labelled ones teach (5); no letters or a text that fits
    none of them goes."""
    with_package(spark)
    return language_id.accepted_rows(docs, docs.where(~language_id.held_out()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (7)."""
    with_package(spark)
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more (3)."""
    with_package(spark)
    return near_dup.kept_rows(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, some left out and some repeated (1)."""
    with_package(spark)
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of the text, with the digests of ids and decoded text (9)."""
    with_package(spark)
    return bpe.digest(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix", mix),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
    return docs
