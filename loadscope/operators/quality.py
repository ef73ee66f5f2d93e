"""Validation, cleaning and profiling.

Scale notes
-----------
* Every profile is one aggregation pass whose partial aggregates are combined map-side;
  per-column results are turned to long form with ``stack`` on the single result row.
* Keyed "last write wins" (A2) is ``max_by(struct, order)`` in a ``groupBy``: partial
  aggregation collapses a hot key before the shuffle, unlike a ``row_number`` window that
  would send all of its rows to one task.
* Medians and quartiles (A4, A9) are exact and distributed (``quantiles``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadscope.functions import fixed
from loadscope.operators.quantiles import exact_quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """S1 helper: raise if required columns are missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


# --------------------------------------------------------------------------- F1-F3
def validate(df: DataFrame, ranges=None, required=None) -> DataFrame:
    """adds ``violations array<string>`` (range rule names and missing fields, in rule
    order) and ``is_valid``."""
    ranges = fixed.RECORD_RANGES if ranges is None else ranges
    required = fixed.REQUIRED_TEXT if required is None else required
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c}:required")) for c in required if c in df.columns]
    for c, lo, hi in ranges:
        if c in df.columns:
            checks.append(F.when(F.col(c).isNull(), F.lit(f"{c}:required"))
                          .when(~F.col(c).between(lo, hi), F.lit(f"{c}:range")))
    v = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return df.withColumn("violations", v).withColumn("is_valid", F.size("violations") == 0)


def validate_text(df: DataFrame, id_col: str = "athlete_id", text_cols=("sport", "position"),
                  date_col: str | None = "date") -> DataFrame:
    """trim, then regex checks; adds ``id_ok``, ``text_ok`` and ``date_ok``."""
    out = df.withColumn(id_col, F.trim(F.col(id_col)))
    out = out.withColumn("id_ok", F.coalesce(F.col(id_col).rlike(fixed.ATHLETE_ID_PATTERN), F.lit(False)))
    text_ok = F.lit(True)
    for c in text_cols:
        out = out.withColumn(c, F.trim(F.col(c)))
        text_ok = text_ok & F.coalesce(F.col(c).rlike(fixed.TEXT_PATTERN), F.lit(False))
    out = out.withColumn("text_ok", text_ok)
    if date_col:
        s = F.trim(F.col(date_col).cast("string"))
        out = out.withColumn("date_ok", F.try_to_date(s, fixed.DATE_FORMAT).isNotNull()
                             & s.rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return out


def repair_athlete_id(df: DataFrame, col: str = "athlete_id") -> DataFrame:
    """keep a valid id, else strip illegal characters and prefix ``ATH-``; empty -> 101."""
    s = F.trim(F.col(col))
    stripped = F.regexp_replace(s, fixed.ID_ILLEGAL_CHARS, "")
    fixed_id = F.concat(F.lit("ATH-"), F.coalesce(F.nullif(stripped, F.lit("")), F.lit(fixed.ID_EMPTY_FALLBACK)))
    repaired = (F.when(s.isNull() | (s == ""), F.lit("ATH-" + fixed.ID_EMPTY_FALLBACK))
                .when(s.rlike(fixed.ATHLETE_ID_PATTERN), s).otherwise(fixed_id))
    return df.withColumn(col, repaired)


# --------------------------------------------------------------------------- F5-F14
def drop_null_target(df: DataFrame, target: str = "injured") -> DataFrame:
    return df.dropna(subset=[target])


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """drop listed columns if present."""
    return df.drop(*[c for c in cols if c in df.columns])


def align_features(df: DataFrame, names: list[str], fill: float = 0.0, keep=()) -> DataFrame:
    """exactly ``names`` in order; missing -> ``fill`` (raw value, before scaling)."""
    cols = [F.col(c) for c in keep]
    cols += [(F.col(n).cast("double") if n in df.columns else F.lit(float(fill))).alias(n) for n in names]
    return df.select(*cols)


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """F8."""
    return [c for c in df.columns if c.startswith(prefix)]


def search_records(df: DataFrame, term: str, cols=("athlete_id", "sport", "position")) -> DataFrame:
    """case-insensitive substring match over any of ``cols``."""
    t = F.lit(term.lower())
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False))
    return df.filter(cond)


def filter_sport(df: DataFrame, sport: str | None, col: str = "sport") -> DataFrame:
    """``None`` / 'All' keeps everything."""
    return df if sport in (None, "All") else df.filter(F.col(col) == sport)


def categories(df: DataFrame, col: str = "sport") -> DataFrame:
    """categories present."""
    return df.select(col).distinct()


def threshold_cut(p: Column, t: float) -> Column:
    """F14."""
    return (p >= F.lit(t)).cast("int")


# --------------------------------------------------------------------------- A1, A2
def dedup(df: DataFrame) -> DataFrame:
    """A1: exact-duplicate removal (map-side partial dedup)."""
    return df.dropDuplicates()


def dedup_report(df: DataFrame) -> DataFrame:
    """A1 report: rows before, after and removed (two aggregations, one scan each)."""
    after = df.dropDuplicates().agg(F.count(F.lit(1))).scalar()  # scalar subquery
    before = df.agg(F.count(F.lit(1)).alias("rows_before"))
    return before.select("rows_before", after.alias("rows_after"),
                         (F.col("rows_before") - after).alias("removed"))


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A2: last write wins per key, by the ``order`` columns (e.g. timestamp, sequence)."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(picked.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


# --------------------------------------------------------------------------- A3-A10
def missing_profile(df: DataFrame) -> DataFrame:
    """A3: per column with nulls: missing count and percent (2 dp); sort by percent desc."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")] + [
        F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("bigint").alias(f"_m{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    parts = ", ".join(f"'{c}', _m{i}" for i, c in enumerate(cols))
    long = one.selectExpr("_n", f"stack({len(cols)}, {parts}) as (column_name, n_missing)")
    return (long.filter(F.col("n_missing") > 0)
            .select("column_name", "n_missing",
                    F.round(F.col("n_missing") * 100.0 / F.col("_n"), 2).alias("pct_missing")))


def schema_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null count, row count (one aggregation pass)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    parts = ", ".join(f"'{c}', '{types[c]}', _c{i}" for i, c in enumerate(cols))
    return one.selectExpr(f"stack({len(cols)}, {parts}) as (column_name, dtype, non_null)", "_n as n_rows")


def describe_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A4: count, mean, sample std, min, 25/50/75 % (linear interpolation, exact), max; 4 dp."""
    cols = cols or numeric_columns(df)
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"_n{i}"), F.avg(x).alias(f"_a{i}"), F.stddev_samp(x).alias(f"_s{i}"),
                 F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
    one = df.agg(*aggs).withColumns({f"_q{i}{k}": F.lit(quartiles[c][k]).cast("double") for i, c in enumerate(cols) for k in range(3)})
    parts = ", ".join(f"'{c}', _n{i}, _a{i}, _s{i}, _lo{i}, _q{i}0, _q{i}1, _q{i}2, _hi{i}"
                      for i, c in enumerate(cols))
    long = one.selectExpr(f"stack({len(cols)}, {parts}) as (column_name, n, mean, std, min, p25, p50, p75, max)")
    return long.select("column_name", "n", *[F.round(c, 4).alias(c) for c in
                                             ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def _value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, n) for every non-null value of every listed column."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])
    return (df.select(F.explode(arr).alias("_kv")).select("_kv.*")
            .filter(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def describe_categorical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A5: count, unique, top (most frequent; smallest value on ties), freq."""
    cols = cols or string_columns(df)
    vc = _value_counts(df, cols)
    return vc.groupBy("column_name").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("top"),
        F.max("n").alias("freq"))


def class_distribution(df: DataFrame, col: str) -> DataFrame:
    """Count and percent (2 dp) per class; the window runs on the tiny grouped result."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return g.select(col, "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2).alias("pct"))


def histogram(df: DataFrame, col: str, bins: int = 5) -> DataFrame:
    """Equal-width bins over [min, max], empty ones included; the maximum falls in the last bin.

    Two passes: a one-row min/max aggregate (read to the driver — one row), then the
    bucketed count; bucket = least(bins, floor((x - lo) * bins / (hi - lo)) + 1)."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bucket bigint, lo double, hi double, n bigint, pct double")
    width = (float(hi) - float(lo))
    x = F.col(col).cast("double")
    b = (F.lit(1) if width == 0 else
         F.least(F.lit(bins), F.floor((x - float(lo)) * bins / width) + 1)).cast("bigint")
    g = df.filter(x.isNotNull()).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    step = width / bins
    g = (df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bucket")).join(g, "bucket", "left")
         .fillna(0, ["n"]))
    return g.select("bucket",
                    (F.lit(float(lo)) + (F.col("bucket") - 1) * step).alias("lo"),
                    (F.lit(float(lo)) + F.col("bucket") * step).alias("hi"),
                    "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1).alias("pct"))


def medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row, one exact median per column."""
    found = exact_quantiles(df, cols, [0.5])
    return df.sparkSession.range(1).select(*[F.lit(found[c][0]).cast("double").alias(c) for c in cols])


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """A10: most frequent value per column, smallest on ties (distributed value counts)."""
    vc = _value_counts(df, cols)
    return vc.groupBy("column_name").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("mode"),
        F.max("n").alias("freq"))
