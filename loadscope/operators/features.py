"""Per-athlete feature engineering.

Scale notes
-----------
* Rolling row frames (W1-W3) run over raw records in time blocks (``time_blocks``): an athlete with more
  than ``BLOCK_ROWS`` records is cut into runs of that many, each with a halo of the rows before it that
  its frames reach, so one athlete spans many tasks. All twelve rolling columns share one
  partition/order spec, so Catalyst plans one exchange and one sort for all of them.
* The whole-history z-score (W6) is an aggregate joined back — not an unordered window —
  so partial aggregation handles a hot athlete and AQE can broadcast the per-athlete stats
  table once its runtime size is known.
* Wide lag columns (W10) come from ``lag`` over a gap-filled day spine, again day grain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscope.functions import scores
from loadscope.session import scratch_path


def _w(key: str, order: list[str]):
    return Window.partitionBy(key).orderBy(*[F.col(c) for c in order])


# --------------------------------------------------------------------------- W1-W3
#: Rows of an athlete that one task's window holds, besides the halo.
BLOCK_ROWS = 1 << 14


def time_blocks(df: DataFrame, key: str, order: list[str], back: int) -> DataFrame:
    """``df`` with ``_block`` and ``_halo``: row frames of up to ``back`` rows before the current one are right within
    (key, _block) for the rows that are no halo. Keys of up to ``BLOCK_ROWS`` rows are one block; the rows of the
    others are numbered by a range shuffle in (key, order), of which only counts per range are summed up, cut every
    ``BLOCK_ROWS`` rows, and the last ``back`` rows of a block are copied to the next one as its halo."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK_ROWS)
    large = sizes.select(F.col(key).alias("_key"))  # at most rows / BLOCK_ROWS keys
    few = df.join(large, F.col(key).eqNullSafe(F.col("_key")), "left_anti").withColumns({"_block": F.lit(0).cast("long"), "_halo": F.lit(False)})
    if large.isEmpty():
        return few
    hot = df.join(large, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    path = scratch_path(df.sparkSession, "time-order")
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot.repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parts = df.sparkSession.read.parquet(path)
    cells = parts.groupBy("_part", F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(F.col("_part").alias("_p"), "_key", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part", key).orderBy(*order)) - 1 + F.col("_before")
    placed = parts.join(cells, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key"))).withColumn("_at", at)
    own = F.floor(F.col("_at") / BLOCK_ROWS)
    blocks = F.when(F.col("_at") % BLOCK_ROWS >= BLOCK_ROWS - back, F.array(own, own + 1)).otherwise(F.array(own))
    out = placed.withColumn("_block", F.explode(blocks)).withColumn("_halo", F.col("_block") != own)
    return few.unionByName(out.select(*df.columns, "_block", "_halo"))


def _frames(key: str, order: list[str]):
    return Window.partitionBy(key, "_block").orderBy(*[F.col(c) for c in order])


def acwr_rows(df: DataFrame, load: str = "weekly_volume_hrs", acute: int = 7, chronic: int = 28,
              key: str = "athlete_id", order=("date",)) -> DataFrame:
    """W1 (row frame, D1): mean of the last `acute` rows / mean of the last `chronic` rows;
    a zero or missing chronic mean gives 1.0."""
    w = _frames(key, list(order))
    a = F.avg(load).over(w.rowsBetween(-(acute - 1), 0))
    c = F.avg(load).over(w.rowsBetween(-(chronic - 1), 0))
    rows = time_blocks(df, key, list(order), max(acute, chronic) - 1)
    out = rows.withColumn("acwr", F.coalesce(F.try_divide(a, F.nullif(c, F.lit(0.0))), F.lit(1.0)))
    return out.where(~F.col("_halo")).drop("_block", "_halo")


def rolling_stats(df: DataFrame, cols=("weekly_volume_hrs", "weekly_intensity_score"),
                  windows=(7, 14, 28), key: str = "athlete_id", order=("date",)) -> DataFrame:
    """Rolling mean and sample std (first row -> 0) with min_periods=1, in one select."""
    w = _frames(key, list(order))
    out = [F.col(c) for c in df.columns]
    for n in windows:
        fr = w.rowsBetween(-(n - 1), 0)
        for c in cols:
            out.append(F.avg(c).over(fr).alias(f"{c}_roll{n}_mean"))
            out.append(F.coalesce(F.stddev_samp(c).over(fr), F.lit(0.0)).alias(f"{c}_roll{n}_std"))
    return time_blocks(df, key, list(order), max(windows) - 1).select(*out, "_halo").where(~F.col("_halo")).drop("_halo")


# --------------------------------------------------------------------------- W6
def athlete_zscore(df: DataFrame, cols, key: str = "athlete_id", expanding: bool = False,
                   order=("d",)) -> DataFrame:
    """(x - athlete mean) / athlete sample std, std 0 -> 1, single row -> NULL.

    ``expanding=True`` uses only earlier rows (frame UNBOUNDED PRECEDING .. 1 PRECEDING, D15)."""
    if expanding:
        w = _w(key, list(order)).rowsBetween(Window.unboundedPreceding, -1)
        out = df
        for c in cols:
            m, s = F.avg(c).over(w), F.stddev_samp(c).over(w)
            out = out.withColumn(f"{c}_ath_zscore", (F.col(c) - m) / F.when(s == 0, F.lit(1.0)).otherwise(s))
        return out
    stats = df.groupBy(key).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                                *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols])
    j = df.join(stats, key, "left")
    for c in cols:
        s = F.col(f"_s_{c}")
        j = j.withColumn(f"{c}_ath_zscore", (F.col(c) - F.col(f"_m_{c}")) / F.when(s == 0, F.lit(1.0)).otherwise(s))
    return j.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


# --------------------------------------------------------------------------- W10 / W7 / W9 / E3 / A15
def to_wide_lags(daily: DataFrame, measures: list[str], n: int = 7, key: str = "athlete_id",
                 day: str = "d") -> DataFrame:
    """Wide lag columns ``<m>_d0 .. <m>_d{n-1}`` from a gap-filled day-grain table
    (``lag(x, k)`` over the athlete's days; missing history -> NULL)."""
    w = Window.partitionBy(key).orderBy(F.unix_date(F.col(day)))
    cols = [F.col(c) for c in daily.columns if c not in measures]
    for m in measures:
        cols.append(F.col(m).alias(f"{m}_d0"))
        cols += [F.lag(m, k).over(w).alias(f"{m}_d{k}") for k in range(1, n)]
    return daily.select(*cols)


def row_sum(cols: list[str]) -> Column:
    """NaN/NULL-skipping row sum (0 when all missing, like pandas)."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0.0)))


def row_mean(cols: list[str]) -> Column:
    """NULL-skipping row mean (NULL when all missing)."""
    n = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
    return F.when(n > 0, row_sum(cols) / n)


def _guard(c: Column) -> Column:
    """``replace(0, 0.01)`` before dividing (ANSI division by zero raises)."""
    return F.when(c == 0, F.lit(0.01)).otherwise(c)


def load_features(wide: DataFrame, n: int = 7) -> DataFrame:
    """E3 + W7 + W9 over a wide lag table with measures total_km, z5_km, sprint_km,
    exertion, recovery."""
    d = range(n)
    km = [f"total_km_d{k}" for k in d]
    hi = [f"z5_km_d{k}" for k in d] + [f"sprint_km_d{k}" for k in d]
    ex = [f"exertion_d{k}" for k in d]
    rc = [f"recovery_d{k}" for k in d]
    out = wide.select(
        "*",
        row_sum(km).alias("weekly_total_km"),
        (row_sum(hi[:n]) + row_sum(hi[n:])).alias("weekly_high_intensity_km"),
        row_mean(ex).alias("mean_perceived_exertion"),
        row_mean(rc).alias("mean_perceived_recovery"),
        (F.col("total_km_d0") - F.col("total_km_d1")).alias("workload_spike"),
        (F.col("exertion_d0") - F.col("exertion_d1")).alias("exertion_spike"),
    )
    return (out.withColumn("exertion_recovery_ratio",
                           F.col("mean_perceived_exertion") / _guard(F.col("mean_perceived_recovery")))
            .withColumn("acute_chronic_exertion", F.col("exertion_d0") / _guard(F.col("mean_perceived_exertion"))))


# --------------------------------------------------------------------------- E1, E2, E4
def add_recovery_score(df: DataFrame) -> DataFrame:
    """E1."""
    return df.withColumn("recovery_score", scores.recovery_score())


def add_injury_history_features(df: DataFrame) -> DataFrame:
    """E2."""
    return df.select("*", *scores.injury_history_flags())


def interaction_features(df: DataFrame) -> DataFrame:
    """E4 on the cross-sectional player table."""
    age, wt, ht = F.col("Player_Age"), F.col("Player_Weight"), F.col("Player_Height")
    it, rt, pi = F.col("Training_Intensity"), F.col("Recovery_Time"), F.col("Previous_Injuries")
    lrr = it / (rt + 0.1)
    hi_int = (it > 0.7).cast("int")
    rec_def = (rt <= 2).cast("int")
    return df.select(
        "*",
        (wt / F.pow(ht / 100.0, 2)).alias("bmi"),
        lrr.alias("load_recovery_ratio"),
        (ht * it).alias("height_x_intensity"),
        (age * it).alias("age_x_intensity"),
        (wt * it).alias("weight_x_intensity"),
        F.pow(it, 2).alias("intensity_squared"),
        F.pow(it, 3).alias("intensity_cubed"),
        (pi * it).alias("prev_injury_load"),
        (pi * lrr).alias("prev_x_load_ratio"),
        (age < 23).cast("int").alias("is_youth"),
        (age > 35).cast("int").alias("is_veteran"),
        rec_def.alias("recovery_deficit"),
        hi_int.alias("high_intensity"),
        (hi_int * rec_def).alias("danger_zone"),
    )


def recent_n(df: DataFrame, n: int, key: str = "athlete_id", order: str = "d") -> DataFrame:
    """Last-N rows per athlete, newest first (``rank`` 1 = newest)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("recency_rank", F.row_number().over(w)).filter(F.col("recency_rank") <= n)
