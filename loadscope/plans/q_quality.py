"""Registered validation / cleaning / profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadscope.functions import fixed
from loadscope.operators import quality
from loadscope.plans.registry import register
from loadscope.sources import views
from loadscope.sources.tables import table

_RANGE_SQL = []
for _c in fixed.REQUIRED_TEXT:
    _RANGE_SQL.append(f"CASE WHEN {_c} IS NULL THEN '{_c}:required' END")
for _c, _lo, _hi in fixed.RECORD_RANGES:
    _RANGE_SQL.append(f"CASE WHEN {_c} IS NULL THEN '{_c}:required' "
                      f"WHEN NOT ({_c} BETWEEN {_lo} AND {_hi}) THEN '{_c}:range' END")
_VIOL = "concat_ws(',', " + ", ".join(_RANGE_SQL) + ")"


@register("f1_validate", f"""
SELECT record_id, {_VIOL} AS violations, {_VIOL} = '' AS is_valid,
       CAST(CASE WHEN {_VIOL} = '' THEN 0 ELSE length({_VIOL}) - length(replace({_VIOL}, ',', '')) + 1 END AS INTEGER)
         AS n_violations
FROM v_dirty""", views=("v_dirty",))
def f1_validate(spark, sf):
    v = quality.validate(views.dirty(spark, sf))
    return v.select("record_id", F.array_join("violations", ",").alias("violations"), "is_valid",
                    F.size("violations").alias("n_violations"))


@register("f1_violation_counts", f"""
SELECT violation, count(*) AS n_rows FROM (
  SELECT unnest(CASE WHEN {_VIOL} = '' THEN ['(valid)'] ELSE string_split({_VIOL}, ',') END) AS violation
  FROM v_dirty) GROUP BY violation""", views=("v_dirty",))
def f1_violation_counts(spark, sf):
    v = quality.validate(views.dirty(spark, sf))
    e = v.select(F.explode(F.when(F.size("violations") == 0, F.array(F.lit("(valid)")))
                           .otherwise(F.col("violations"))).alias("violation"))
    return e.groupBy("violation").agg(F.count(F.lit(1)).alias("n_rows"))


_TXT = "'^[a-zA-Z0-9\\s_\\-\\/\\(\\)\\,]+$'"


def _days_as_text(day: str) -> str:
    return (f"CASE record_id % 13 WHEN 0 THEN concat(' ', {day}, ' ') WHEN 1 THEN replace({day}, '-', '/') "
            f"WHEN 2 THEN concat(substr({day}, 1, 5), '02-30') WHEN 3 THEN concat(substr({day}, 1, 5), '13-01') "
            f"WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN concat({day}, 'T00:00') WHEN 7 THEN substr({day}, 3, 8) ELSE {day} END")


_DAYS, _DAYS_SQL = _days_as_text("CAST(date AS STRING)"), _days_as_text("CAST(date AS VARCHAR)")


@register("f2_validate_text", f"""
SELECT record_id, trim(athlete_id) AS athlete_id,
       coalesce(regexp_matches(trim(athlete_id), '^ATH-[a-zA-Z0-9_-]+$'), false) AS id_ok,
       coalesce(regexp_matches(trim(sport), {_TXT}), false)
         AND coalesce(regexp_matches(trim(position), {_TXT}), false) AS text_ok,
       coalesce(regexp_matches(trim(day), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND TRY_CAST(trim(day) AS DATE) IS NOT NULL, false) AS date_ok
FROM (SELECT *, """ + _DAYS_SQL + """ AS day FROM v_dirty)""", views=("v_dirty",))
def f2_validate_text(spark, sf):
    """The dates arrive as text: some with blanks around, some in another form, of no such day, empty or missing."""
    dates = views.dirty(spark, sf).withColumn("date", F.expr(_DAYS))
    v = quality.validate_text(dates)
    return v.select("record_id", "athlete_id", "id_ok", "text_ok", "date_ok")


@register("f3_repair_id", """
SELECT record_id, CASE WHEN trim(athlete_id) IS NULL OR trim(athlete_id) = '' THEN 'ATH-101'
  WHEN regexp_matches(trim(athlete_id), '^ATH-[a-zA-Z0-9_-]+$') THEN trim(athlete_id)
  ELSE 'ATH-' || coalesce(nullif(regexp_replace(trim(athlete_id), '[^a-zA-Z0-9_-]', '', 'g'), ''), '101')
  END AS athlete_id
FROM v_dirty""", views=("v_dirty",))
def f3_repair_id(spark, sf):
    return quality.repair_athlete_id(views.dirty(spark, sf)).select("record_id", "athlete_id")


@register("f5_drop_null_target", """
SELECT record_id, injured FROM v_dirty WHERE injured IS NOT NULL""", views=("v_dirty",))
def f5_drop_null_target(spark, sf):
    return quality.drop_null_target(views.dirty(spark, sf), "injured").select("record_id", "injured")


@register("f6_f7_align_features", """
SELECT record_id, weekly_volume_hrs, CAST(rest_days AS DOUBLE) AS rest_days, 0.0::DOUBLE AS acwr,
       sleep_hours FROM v_record""", views=("v_record",))
def f6_f7_align_features(spark, sf):
    df = quality.drop_columns(views.records(spark, sf), ["athlete_id", "date", "no_such_column"])
    return quality.align_features(df, ["weekly_volume_hrs", "rest_days", "acwr", "sleep_hours"],
                                  keep=["record_id"])


@register("f8_prefix_select", """
SELECT record_id, weekly_volume_hrs, weekly_intensity_score FROM v_record""", views=("v_record",))
def f8_prefix_select(spark, sf):
    df = views.records(spark, sf)
    return df.select("record_id", *quality.columns_with_prefix(df, "weekly_"))


@register("f10_search", """
SELECT record_id, athlete_id, sport, position FROM v_record
WHERE contains(lower(athlete_id), 'mid') OR contains(lower(sport), 'mid')
   OR contains(lower(position), 'mid')""", views=("v_record",))
def f10_search(spark, sf):
    return quality.search_records(views.records(spark, sf), "MID").select(
        "record_id", "athlete_id", "sport", "position")


@register("f11_sport_filter", """
SELECT record_id, sport FROM v_record WHERE sport = 'Rugby'""", views=("v_record",))
def f11_sport_filter(spark, sf):
    return quality.filter_sport(views.records(spark, sf), "Rugby").select("record_id", "sport")


@register("f11_categories", """SELECT DISTINCT sport FROM v_sessions""", views=("v_sessions",))
def f11_categories(spark, sf):
    return quality.categories(views.sessions(spark, sf), "sport")


@register("a1_dedup_report", """
SELECT (SELECT count(*) FROM v_dirty) AS rows_before,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM v_dirty)) AS rows_after,
       (SELECT count(*) FROM v_dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v_dirty)) AS removed
""", views=("v_dirty",))
def a1_dedup_report(spark, sf):
    return quality.dedup_report(views.dirty(spark, sf))


@register("a2_latest_daily_log", """
SELECT athlete_id, d, write_id, ts, hrv, rhr, sleep_hours, soreness_score FROM (
  SELECT *, row_number() OVER (PARTITION BY athlete_id, d ORDER BY ts DESC, write_id DESC) AS rn
  FROM v_log_writes) WHERE rn = 1""", views=("v_log_writes",))
def a2_latest_daily_log(spark, sf):
    return quality.latest_by_key(views.log_writes(spark, sf), ["athlete_id", "d"], ["ts", "write_id"])


def _dirty_cols():
    return ["record_id", "athlete_id", "date", "sport", "position", "age", "weight_kg", "height_cm",
            "weekly_volume_hrs", "weekly_intensity_score", "sleep_hours", "hrv_ms", "soreness_score",
            "rest_days", "prior_injuries", "days_since_last_injury", "rhr", "injured"]


_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS pct_missing FROM v_dirty"
    for c in _dirty_cols())


@register("a3_missing_profile", f"SELECT * FROM ({_MISSING}) WHERE n_missing > 0", views=("v_dirty",))
def a3_missing_profile(spark, sf):
    return quality.missing_profile(views.dirty(spark, sf))


_DESC_COLS = ["record_id", "age", "weight_kg", "height_cm", "weekly_volume_hrs", "weekly_intensity_score", "sleep_hours",
              "hrv_ms", "soreness_score", "rest_days", "prior_injuries", "days_since_last_injury", "rhr", "injured"]
_DESC = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS std, round(min({c}), 4)::DOUBLE AS min, "
    f"round(quantile_cont({c}, 0.25), 4)::DOUBLE AS p25, round(quantile_cont({c}, 0.5), 4)::DOUBLE AS p50, "
    f"round(quantile_cont({c}, 0.75), 4)::DOUBLE AS p75, round(max({c}), 4)::DOUBLE AS max FROM v_record"
    for c in _DESC_COLS)


@register("a4_describe_numeric", _DESC, views=("v_record",))
def a4_describe_numeric(spark, sf):
    return quality.describe_numeric(views.records(spark, sf))


_STRING_COLS = ["athlete_id", "sport", "position"]
_CAT = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, sum(n) ::BIGINT AS count, count(*) AS unique,
        arg_min(value, (-n, value)) AS top, max(n) AS freq
        FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM v_dirty WHERE {c} IS NOT NULL GROUP BY 1)"""
    for c in _STRING_COLS)


@register("a5_describe_categorical", _CAT, views=("v_dirty",))
def a5_describe_categorical(spark, sf):
    return quality.describe_categorical(views.dirty(spark, sf), _STRING_COLS)


@register("a6_class_distribution", """
SELECT injured, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct
FROM v_dirty GROUP BY injured""", views=("v_dirty",))
def a6_class_distribution(spark, sf):
    return quality.class_distribution(views.dirty(spark, sf), "injured")


_TYPES = {"record_id": "bigint", "athlete_id": "string", "date": "date", "sport": "string",
          "position": "string", "rest_days": "int", "prior_injuries": "int", "rhr": "int", "injured": "int"}
_SCHEMA = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{_TYPES.get(c, 'double')}' AS dtype, count({c}) AS non_null, "
    f"count(*) AS n_rows FROM v_dirty" for c in _dirty_cols())


@register("a7_schema_profile", _SCHEMA, views=("v_dirty",))
def a7_schema_profile(spark, sf):
    return quality.schema_profile(views.dirty(spark, sf))


@register("a8_histogram", """
WITH mm AS (SELECT min(weekly_volume_hrs) AS lo, max(weekly_volume_hrs) AS hi FROM v_record),
b AS (SELECT CAST(least(5, floor((weekly_volume_hrs - lo) * 5 / (hi - lo)) + 1) AS BIGINT) AS bucket, lo, hi
      FROM v_record, mm WHERE weekly_volume_hrs IS NOT NULL)
SELECT k AS bucket, any_value(mm.lo) + (k - 1) * ((any_value(mm.hi) - any_value(mm.lo)) / 5) AS lo,
       any_value(mm.lo) + k * ((any_value(mm.hi) - any_value(mm.lo)) / 5) AS hi, count(b.bucket) AS n,
       round(count(b.bucket) * 100.0 / sum(count(b.bucket)) OVER (), 1) AS pct
FROM (SELECT CAST(unnest(range(1, 6)) AS BIGINT) AS k) s CROSS JOIN mm LEFT JOIN b ON b.bucket = k GROUP BY k""", views=("v_record",))
def a8_histogram(spark, sf):
    return quality.histogram(views.records(spark, sf), "weekly_volume_hrs", 5)


@register("a8_histogram_empty_bins", """
WITH x AS (SELECT CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN 1 ELSE 10 END AS DOUBLE) AS v FROM orders),
b AS (SELECT CAST(least(5, floor(v * 5 / 10) + 1) AS BIGINT) AS bucket FROM x)
SELECT k AS bucket, (k - 1) * 2.0::DOUBLE AS lo, k * 2.0::DOUBLE AS hi, count(b.bucket) AS n,
       round(count(b.bucket) * 100.0 / sum(count(b.bucket)) OVER (), 1) AS pct
FROM (SELECT CAST(unnest(range(1, 6)) AS BIGINT) AS k) s LEFT JOIN b ON b.bucket = k GROUP BY k""")
def a8_histogram_empty_bins(spark, sf):
    k = F.col("o_orderkey") % 3
    v = F.when(k == 0, 0.0).when(k == 1, 1.0).otherwise(10.0)
    return quality.histogram(table(spark, sf, "orders", "o_orderkey").select(v.alias("v")), "v", 5)


_MED_COLS = _DESC_COLS


@register("a9_medians", "SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5)::DOUBLE AS {c}" for c in _MED_COLS) + " FROM v_dirty", views=("v_dirty",))
def a9_medians(spark, sf):
    return quality.medians(views.dirty(spark, sf), _MED_COLS)


_MODE = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, arg_min(value, (-n, value)) AS mode, max(n) AS freq
        FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM v_dirty WHERE {c} IS NOT NULL GROUP BY 1)"""
    for c in _STRING_COLS)


@register("a10_modes", _MODE, views=("v_dirty",))
def a10_modes(spark, sf):
    return quality.modes(views.dirty(spark, sf), _STRING_COLS)
