"""The registered queries of this subpackage (whole tables) and, where SQL says the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loadscope.llm import bpe, decontaminate, exact_dedup, language_id, merkle, mixing, near_dup, quality, repeats, resampling, sharding, token_file, top_k, twins
from loadscope.llm.common import with_package
from loadscope.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(with_package(spark), sf_dir)
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_mix_sources")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


@register("op2_token_file")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.digest(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


@register("op3_minhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.digest(table(spark, sf_dir, "documents"))


@register("op4_kneser_ney_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents"))


@register("op6_repeated_strings")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


@register("op7_exact_dedup", sql=r"""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                      regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
    g AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY norm) AS size,
                 first_value(doc_id) OVER w AS keep_id
          FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id))
    SELECT doc_id, keep_id, size AS group_size, r = 1 AS kept, sha256(norm) AS text_sha256 FROM g""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


@register("op8_top_k_search", sql="""
    WITH v AS (SELECT vec_id, list_transform(embedding, x -> CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), p -> p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.digest(table(spark, sf_dir, "embeddings"))


@register("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op10_hilbert_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"), 40)


@register("op11_decontaminate", sql=twins.DECONTAMINATE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op12_importance_resampling", sql=twins.RESAMPLING)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op13_merkle_manifest", sql=twins.MERKLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))
