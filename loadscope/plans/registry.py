"""Query registry: id -> (Spark plan builder, DuckDB oracle SQL or None).

A plan builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the whole
driver tables. Oracle SQL is written against the driver's base tables with the derived
views inlined as CTEs (``oracle_views.with_views``). Column names and types match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loadscope.plans.oracle_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = (),
             extra: list[tuple[str, str]] | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query id {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views, extra=extra)
        return fn
    return deco


# SQL fragments shared by oracle texts -------------------------------------------------
def sql_ratio_pct(num: str, den: str, scale: int = 100) -> str:
    """DuckDB twin of ``rounding.ratio_pct`` (exact integer half-up)."""
    return f"(CASE WHEN ({den}) > 0 THEN (2 * {scale} * ({num}) + ({den})) // (2 * ({den})) END)"


def sql_round_js(x: str) -> str:
    return f"floor(({x}) + 0.5)"


def sql_zone(pct: str) -> str:
    from loadscope.functions import fixed
    (u, _), (o, _), (c, _), (d, _) = fixed.ACWR_ZONES
    return (f"(CASE WHEN {pct} < 80 THEN '{u}' WHEN {pct} <= 130 THEN '{o}' "
            f"WHEN {pct} <= 150 THEN '{c}' ELSE '{d}' END)")
