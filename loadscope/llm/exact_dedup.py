"""Operator 7: exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after deleting white space. One scan gives every row's normalised
length and the hash of its first ``PREFIX`` normalised characters. Rows whose length nobody shares
are settled; of the rest, rows whose (length, prefix hash) nobody shares; only the documents that
are left have their full content read and hashed (SHA-256). All grouping is by partial aggregation
and equi-joins on keys that are unique on one side, so a group that holds a third of all rows is
counted before it is shuffled, and its join can be split.

Of equal texts the row with the most code points stays, then the smallest doc_id (null last).
Null text counts as the empty text. Rows that repeat a doc_id are members of their text's group
like any other; rows equal in doc_id and length of text too share keep_id, and ``kept`` is true for
all of them (``kept_rows`` keeps one). Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import SPACES, dropped, fresh, saved

PREFIX = 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text_sha256, keep_id, keep_points, group_size) of every text that two rows or more share."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    norm = normalised(F.col("text"))
    sizes = saved(rows.select("doc_id", norm.alias("norm"))
                  .select("doc_id", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("head")), "lengths")
    shared_len = sizes.groupBy("len").count().where("count > 1").select("len")
    left = sizes.join(shared_len, "len", "left_semi")
    shared_head = left.groupBy("len", "head").count().where("count > 1").select("len", "head")
    left = left.join(shared_head, ["len", "head"], "left_semi").select("doc_id").distinct()
    # eqNullSafe: a null doc_id is a document like any other.
    full = rows.join(left.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    full = full.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), F.sha2(norm, 256).alias("text_sha256"))
    best = F.max_by("doc_id", F.struct("points", -F.col("doc_id")))
    groups = full.groupBy("text_sha256").agg(best.alias("keep_id"), F.max("points").alias("keep_points"),
                                             F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = saved(groups, "groups")
    dropped(docs.sparkSession, sizes)
    return groups


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row (the digest of a row's text is all
    that is computed here; which rows are equal comes from ``duplicate_groups``)."""
    groups = duplicate_groups(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
                       F.sha2(normalised(F.col(text)), 256).alias("text_sha256"))
    out = rows.join(groups, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")))).alias("kept"),
        "text_sha256")


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one of rows equal in doc_id and text.

    One shuffle of the rows, by (doc_id, digest): near-unique keys, so no group is hot in it."""
    def key(i: Column, h: Column) -> Column:
        return F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("null")), h)

    name = fresh(docs, "_kept_key")
    stay = decisions(docs, doc_id, text).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias(name))
    held = docs.withColumn(name, key(F.col(doc_id), F.sha2(normalised(F.col(text)), 256))).join(stay, name, "left_semi")
    return held.dropDuplicates([name]).drop(name)
