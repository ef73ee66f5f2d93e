"""Registered feature-engineering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadscope.operators import features, quality
from loadscope.plans.registry import register
from loadscope.sources import views


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 dp (oracle hygiene: summation order differs)."""
    return df.select(*[F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


_ORD = "PARTITION BY athlete_id ORDER BY date, record_id"


@register("w1_acwr_rows", f"""
SELECT record_id, athlete_id, round(coalesce(
  avg(weekly_volume_hrs) OVER ({_ORD} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
  / nullif(avg(weekly_volume_hrs) OVER ({_ORD} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 0), 1.0), 6) AS acwr
FROM v_record""", views=("v_record",))
def w1_acwr_rows(spark, sf):
    r = views.records(spark, sf)
    return r6(features.acwr_rows(r, order=("date", "record_id")).select("record_id", "athlete_id", "acwr"))


_ROLL = ", ".join(
    f"round(avg({c}) OVER ({_ORD} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS {c}_roll{n}_mean, "
    f"round(coalesce(stddev_samp({c}) OVER ({_ORD} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0.0), 6) "
    f"AS {c}_roll{n}_std"
    for n in (7, 14, 28) for c in ("weekly_volume_hrs", "weekly_intensity_score"))


@register("w2_w3_rolling_stats", f"SELECT record_id, {_ROLL} FROM v_record", views=("v_record",))
def w2_w3_rolling_stats(spark, sf):
    r = views.records(spark, sf).select("record_id", "athlete_id", "date", "weekly_volume_hrs",
                                        "weekly_intensity_score")
    out = features.rolling_stats(r, order=("date", "record_id"))
    return r6(out.drop("athlete_id", "date", "weekly_volume_hrs", "weekly_intensity_score"))


_Z = ", ".join(
    f"round(({c} - avg({c}) OVER (PARTITION BY athlete_id)) / CASE WHEN stddev_samp({c}) OVER (PARTITION BY athlete_id) = 0 "
    f"THEN 1.0 ELSE stddev_samp({c}) OVER (PARTITION BY athlete_id) END, 6) AS {c}_ath_zscore"
    for c in ("total_km", "exertion", "recovery"))


@register("w6_athlete_zscore", f"SELECT athlete_id, d, {_Z} FROM v_measures", views=("v_measures",))
def w6_athlete_zscore(spark, sf):
    m = views.daily_measures(spark, sf)
    z = features.athlete_zscore(m, ["total_km", "exertion", "recovery"])
    return r6(z.select("athlete_id", "d", "total_km_ath_zscore", "exertion_ath_zscore", "recovery_ath_zscore"))


MEASURES = ["total_km", "z5_km", "sprint_km", "exertion", "recovery"]
_LAGS = ", ".join(
    (f"{m} AS {m}_d0" if k == 0 else f"lag({m}, {k}) OVER (PARTITION BY athlete_id ORDER BY d) AS {m}_d{k}")
    for m in MEASURES for k in range(7))
_WIDE_SQL = f"SELECT athlete_id, d, n_sessions, injury, {_LAGS} FROM v_measures"


def _wide(spark, sf):
    return features.to_wide_lags(views.daily_measures(spark, sf), MEASURES, 7)


@register("w10_wide_lags", _WIDE_SQL, views=("v_measures",))
def w10_wide_lags(spark, sf):
    return r6(_wide(spark, sf))


def _sum(cols):
    return " + ".join(f"coalesce({c}, 0.0)" for c in cols)


def _mean(cols):
    n = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cols)
    return f"(CASE WHEN ({n}) > 0 THEN ({_sum(cols)}) / ({n}) END)"


_KM = [f"total_km_d{k}" for k in range(7)]
_Z5 = [f"z5_km_d{k}" for k in range(7)]
_SP = [f"sprint_km_d{k}" for k in range(7)]
_EX = [f"exertion_d{k}" for k in range(7)]
_RC = [f"recovery_d{k}" for k in range(7)]


@register("e3_w7_w9_a15_load_features", f"""
WITH wide AS ({_WIDE_SQL}),
f AS (SELECT athlete_id, d, injury, {_sum(_KM)} AS weekly_total_km,
             ({_sum(_Z5)}) + ({_sum(_SP)}) AS weekly_high_intensity_km,
             {_mean(_EX)} AS mean_perceived_exertion, {_mean(_RC)} AS mean_perceived_recovery,
             total_km_d0 - total_km_d1 AS workload_spike, exertion_d0 - exertion_d1 AS exertion_spike,
             exertion_d0 FROM wide)
SELECT athlete_id, d, injury, round(weekly_total_km, 6) AS weekly_total_km,
       round(weekly_high_intensity_km, 6) AS weekly_high_intensity_km,
       round(mean_perceived_exertion, 6) AS mean_perceived_exertion,
       round(mean_perceived_recovery, 6) AS mean_perceived_recovery,
       round(workload_spike, 6) AS workload_spike, round(exertion_spike, 6) AS exertion_spike,
       round(mean_perceived_exertion / CASE WHEN mean_perceived_recovery = 0 THEN 0.01 ELSE mean_perceived_recovery END, 6)
         AS exertion_recovery_ratio,
       round(exertion_d0 / CASE WHEN mean_perceived_exertion = 0 THEN 0.01 ELSE mean_perceived_exertion END, 6)
         AS acute_chronic_exertion
FROM f""", views=("v_measures",))
def e3_w7_w9_a15_load_features(spark, sf):
    f = features.load_features(_wide(spark, sf))
    return r6(f.select("athlete_id", "d", "injury", "weekly_total_km", "weekly_high_intensity_km",
                       "mean_perceived_exertion", "mean_perceived_recovery", "workload_spike", "exertion_spike",
                       "exertion_recovery_ratio", "acute_chronic_exertion"))


@register("w11_recent_logs", """
SELECT athlete_id, d, recency_rank FROM (
  SELECT athlete_id, d, row_number() OVER (PARTITION BY athlete_id ORDER BY d DESC) AS recency_rank
  FROM (SELECT DISTINCT athlete_id, d FROM v_log_writes)) WHERE recency_rank <= 14""", views=("v_log_writes",))
def w11_recent_logs(spark, sf):
    logs = quality.latest_by_key(views.log_writes(spark, sf), ["athlete_id", "d"], ["ts", "write_id"])
    return features.recent_n(logs.select("athlete_id", "d"), 14).select(
        "athlete_id", "d", F.col("recency_rank").cast("bigint").alias("recency_rank"))


@register("e1_e2_record_features", """
SELECT record_id,
  round(0.3 * (CASE WHEN sleep_hours IS NOT NULL THEN least(10.0, greatest(4.0, sleep_hours)) END - 4.0) / 6.0
      + 0.3 * (CASE WHEN hrv_ms IS NOT NULL THEN least(100.0, greatest(20.0, hrv_ms)) END - 20.0) / 80.0
      + 0.25 * (1.0 - least(10.0, greatest(0.0, soreness_score)) / 10.0)
      + 0.15 * least(3.0, greatest(0.0, CAST(rest_days AS DOUBLE))) / 3.0, 6) AS recovery_score,
  CAST(coalesce(prior_injuries >= 3, false) AS INTEGER) AS high_injury_history,
  CAST(coalesce(days_since_last_injury < 30, false) AS INTEGER) AS recent_injury,
  round(ln(1 + days_since_last_injury), 6) AS log_days_since_injury
FROM v_dirty""", views=("v_dirty",))
def e1_e2_record_features(spark, sf):
    d = features.add_injury_history_features(features.add_recovery_score(views.dirty(spark, sf)))
    return r6(d.select("record_id", "recovery_score", "high_injury_history", "recent_injury",
                       "log_days_since_injury"))


@register("e4_interaction_features", """
SELECT record_id,
  round(Player_Weight / pow(Player_Height / 100.0, 2), 6) AS bmi,
  round(Training_Intensity / (Recovery_Time + 0.1), 6) AS load_recovery_ratio,
  round(Player_Height * Training_Intensity, 6) AS height_x_intensity,
  round(Player_Age * Training_Intensity, 6) AS age_x_intensity,
  round(Player_Weight * Training_Intensity, 6) AS weight_x_intensity,
  round(pow(Training_Intensity, 2), 6) AS intensity_squared,
  round(pow(Training_Intensity, 3), 6) AS intensity_cubed,
  round(Previous_Injuries * Training_Intensity, 6) AS prev_injury_load,
  round(Previous_Injuries * (Training_Intensity / (Recovery_Time + 0.1)), 6) AS prev_x_load_ratio,
  CAST(Player_Age < 23 AS INTEGER) AS is_youth, CAST(Player_Age > 35 AS INTEGER) AS is_veteran,
  CAST(Recovery_Time <= 2 AS INTEGER) AS recovery_deficit, CAST(Training_Intensity > 0.7 AS INTEGER) AS high_intensity,
  CAST(Training_Intensity > 0.7 AS INTEGER) * CAST(Recovery_Time <= 2 AS INTEGER) AS danger_zone
FROM v_players""", views=("v_players",))
def e4_interaction_features(spark, sf):
    f = features.interaction_features(views.players(spark, sf))
    return r6(f.drop("Player_Age", "Player_Weight", "Player_Height", "Previous_Injuries", "Training_Intensity",
                     "Recovery_Time", "Likelihood_of_Injury"))
