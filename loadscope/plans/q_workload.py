"""Registered workload queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadscope.operators import quality, workload
from loadscope.plans.registry import register, sql_ratio_pct, sql_round_js, sql_zone
from loadscope.sources import views

# The driver's events cover 2024-01-01 .. 2024-01-30; "as of" is a parameter.
AS_OF = "2024-01-30"

_SPINE = f"""
  bounds AS (SELECT athlete_id, min(d) AS lo, greatest(max(d), DATE '{AS_OF}') AS hi FROM v_daily GROUP BY athlete_id),
  spine AS (SELECT athlete_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                   INTERVAL 1 DAY)) AS DATE) AS d FROM bounds),
  filled AS (SELECT s.athlete_id, s.d, coalesce(v.load, 0) AS load
             FROM spine s LEFT JOIN v_daily v ON s.athlete_id = v.athlete_id AND s.d = v.d),
  w AS (SELECT athlete_id, d, load,
          sum(load) OVER (PARTITION BY athlete_id ORDER BY d
                          RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS acute,
          sum(load) OVER (PARTITION BY athlete_id ORDER BY d
                          RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW) AS chronic28
        FROM filled),
  r AS (SELECT *, coalesce(""" + sql_ratio_pct("4 * acute", "chronic28") + """, 0) AS ratio_pct FROM w)
"""


def _acwr(spark, sf):
    return workload.acwr_daily(views.daily(spark, sf), through=AS_OF)


@register("w5_acwr_zone_daily", "WITH" + _SPINE.rstrip() + f"""
SELECT {sql_zone('ratio_pct')} AS zone, count(*) AS athlete_days, CAST(sum(acute) AS BIGINT) AS sum_acute
FROM r GROUP BY 1""", views=("v_daily",))
def w5_acwr_zone_daily(spark, sf):
    return workload.zone_summary(_acwr(spark, sf))


@register("w5_acwr_daily", "WITH" + _SPINE.rstrip() + f"""
SELECT athlete_id, d, CAST(load AS BIGINT) AS load, CAST(acute AS BIGINT) AS acute,
       CAST((chronic28 + 2) // 4 AS BIGINT) AS chronic, ratio_pct / 100.0 AS ratio,
       CAST(ratio_pct AS BIGINT) AS ratio_pct FROM r""", views=("v_daily",))
def w5_acwr_daily(spark, sf):
    return _acwr(spark, sf)


def _daily_logs(spark, sf):
    return quality.latest_by_key(views.log_writes(spark, sf), ["athlete_id", "d"], ["ts", "write_id"])


_LOGS_SQL = ("logs", """
  SELECT athlete_id, d, write_id, ts, hrv, rhr, sleep_hours, soreness_score FROM (
    SELECT *, row_number() OVER (PARTITION BY athlete_id, d ORDER BY ts DESC, write_id DESC) AS rn
    FROM v_log_writes) WHERE rn = 1""")


@register("w4_acwr_as_of", f"""
SELECT athlete_id, acute_load, CAST((load28 + 2) // 4 AS BIGINT) AS chronic_load,
       coalesce({sql_ratio_pct('4 * acute_load', 'load28')}, 0) / 100.0 AS ratio,
       CAST(coalesce({sql_ratio_pct('4 * acute_load', 'load28')}, 0) AS BIGINT) AS ratio_pct
FROM (SELECT a.athlete_id,
             CAST(sum(CASE WHEN d BETWEEN DATE '2024-01-24' AND DATE '{AS_OF}' THEN load ELSE 0 END) AS BIGINT) AS acute_load,
             CAST(sum(CASE WHEN d BETWEEN DATE '2024-01-03' AND DATE '{AS_OF}' THEN load ELSE 0 END) AS BIGINT) AS load28
      FROM v_athletes a LEFT JOIN v_sessions s ON a.athlete_id = s.athlete_id GROUP BY a.athlete_id)""",
          views=("v_athletes", "v_sessions"))
def w4_acwr_as_of(spark, sf):
    return workload.acwr_as_of(views.sessions(spark, sf), AS_OF, athletes=views.athletes(spark, sf))


@register("w5_acwr_last28", f"""
WITH grid AS (SELECT athlete_id, CAST(unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '{AS_OF}',
                     INTERVAL 1 DAY)) AS DATE) AS d FROM v_athletes),
s AS (SELECT g.athlete_id, g.d, coalesce(max(CASE WHEN v.d = g.d THEN v.load END), 0) AS load,
             coalesce(sum(CASE WHEN v.d >= g.d - 6 THEN v.load END), 0) AS acute, coalesce(sum(v.load), 0) AS chronic28
      FROM grid g LEFT JOIN v_daily v ON v.athlete_id = g.athlete_id AND v.d BETWEEN g.d - 27 AND g.d
      GROUP BY g.athlete_id, g.d)
SELECT athlete_id, d, CAST(load AS BIGINT) AS load, CAST(acute AS BIGINT) AS acute,
       CAST((chronic28 + 2) // 4 AS BIGINT) AS chronic,
       coalesce({sql_ratio_pct('4 * acute', 'chronic28')}, 0) / 100.0 AS ratio,
       CAST(coalesce({sql_ratio_pct('4 * acute', 'chronic28')}, 0) AS BIGINT) AS ratio_pct FROM s""",
          views=("v_athletes", "v_daily"))
def w5_acwr_last28(spark, sf):
    return workload.acwr_daily(views.daily(spark, sf), start="2024-01-03", end=AS_OF,
                               athletes=views.athletes(spark, sf))


@register("a11_load_summary", f"""
WITH w AS (SELECT * FROM v_sessions WHERE d BETWEEN DATE '2024-01-24' AND DATE '{AS_OF}')
SELECT a.athlete_id, count(session_id) AS n_sessions, CAST(coalesce(sum(load), 0) AS BIGINT) AS total_load,
       round(coalesce(sum(duration), 0) / 60.0, 4) AS volume_hrs,
       CASE WHEN count(session_id) = 0 THEN 7.0::DOUBLE ELSE round(avg(coalesce(rpe, 5)), 4) END AS avg_rpe
FROM v_athletes a LEFT JOIN w ON a.athlete_id = w.athlete_id GROUP BY a.athlete_id""",
          views=("v_athletes", "v_sessions"))
def a11_load_summary(spark, sf):
    s = workload.load_summary(views.sessions(spark, sf), AS_OF, 7, athletes=views.athletes(spark, sf))
    return s.select("athlete_id", "n_sessions", "total_load", F.round("volume_hrs", 4).alias("volume_hrs"),
                    F.round("avg_rpe", 4).alias("avg_rpe"))


@register("a12_lifetime_summary", """
SELECT coalesce(s.athlete_id, l.athlete_id) AS athlete_id, coalesce(n_sessions, 0) AS n_sessions,
       coalesce(total_load, 0) AS total_load, avg_duration, avg_rpe, coalesce(days_tracked, 0) AS days_tracked
FROM (SELECT athlete_id, count(*) AS n_sessions, CAST(sum(load) AS BIGINT) AS total_load,
             CAST(floor(avg(duration) + 0.5) AS BIGINT) AS avg_duration,
             floor(avg(rpe) * 10.0 + 0.5) / 10.0 AS avg_rpe
      FROM v_sessions GROUP BY athlete_id) s
FULL JOIN (SELECT athlete_id, count(*) AS days_tracked FROM logs GROUP BY athlete_id) l
  ON s.athlete_id = l.athlete_id""", views=("v_sessions", "v_log_writes"), extra=[_LOGS_SQL])
def a12_lifetime_summary(spark, sf):
    return workload.lifetime_summary(views.sessions(spark, sf), _daily_logs(spark, sf))


@register("a13_daily_load", f"""
WITH spine AS (SELECT athlete_id, CAST(unnest(generate_series(TIMESTAMP '2024-01-24', TIMESTAMP '{AS_OF}',
                      INTERVAL 1 DAY)) AS DATE) AS d FROM v_athletes),
f AS (SELECT s.athlete_id, s.d, coalesce(v.load, 0) AS load FROM spine s
      LEFT JOIN v_daily v ON s.athlete_id = v.athlete_id AND s.d = v.d)
SELECT athlete_id, d, CAST(load AS BIGINT) AS load,
       CAST(floor(load * 100.0 / greatest(max(load) OVER (PARTITION BY athlete_id), 1) + 0.5) AS BIGINT) AS bar_pct
FROM f""", views=("v_athletes", "v_daily"))
def a13_daily_load(spark, sf):
    return workload.daily_load(views.daily(spark, sf), AS_OF, 7, athletes=views.athletes(spark, sf))


@register("a14_weekly_buckets", f"""
WITH g AS (SELECT athlete_id, CAST(date_diff('day', d, DATE '{AS_OF}') // 7 AS BIGINT) AS week_back,
                  CAST(sum(load) AS BIGINT) AS load, count(*) AS n_sessions
           FROM v_sessions WHERE d BETWEEN DATE '2024-01-03' AND DATE '{AS_OF}' GROUP BY 1, 2),
spine AS (SELECT athlete_id, CAST(unnest(range(0, 4)) AS BIGINT) AS week_back FROM v_athletes)
SELECT s.athlete_id, s.week_back, coalesce(g.load, 0) AS load, coalesce(g.n_sessions, 0) AS n_sessions
FROM spine s LEFT JOIN g ON s.athlete_id = g.athlete_id AND s.week_back = g.week_back""",
          views=("v_athletes", "v_sessions"))
def a14_weekly_buckets(spark, sf):
    return workload.weekly_buckets(views.sessions(spark, sf), AS_OF, 4, athletes=views.athletes(spark, sf))


@register("a16_discomfort_daily", """
SELECT athlete_id, d, count(*) AS affected_zones, max(severity) AS max_severity,
       string_agg(zone, ',' ORDER BY zone) AS zones
FROM v_discomfort GROUP BY athlete_id, d""", views=("v_discomfort",))
def a16_discomfort_daily(spark, sf):
    return workload.discomfort_daily(views.discomfort(spark, sf))


@register("a16_zone_recurrence", """
SELECT athlete_id, zone, count(*) AS days_reported,
       CAST(sum(CASE WHEN severity = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_mild,
       CAST(sum(CASE WHEN severity = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_moderate,
       CAST(sum(CASE WHEN severity = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_severe
FROM v_discomfort GROUP BY athlete_id, zone""", views=("v_discomfort",))
def a16_zone_recurrence(spark, sf):
    return workload.zone_recurrence(views.discomfort(spark, sf))


@register("a17_completion_flags", """
SELECT coalesce(l.athlete_id, w.athlete_id) AS athlete_id, coalesce(l.d, w.d) AS d,
       l.athlete_id IS NOT NULL AS has_log, w.athlete_id IS NOT NULL AS has_workout
FROM (SELECT athlete_id, d FROM logs) l FULL JOIN v_daily w ON l.athlete_id = w.athlete_id AND l.d = w.d""",
          views=("v_daily", "v_log_writes"), extra=[_LOGS_SQL])
def a17_completion_flags(spark, sf):
    return workload.completion_flags(_daily_logs(spark, sf), views.daily(spark, sf))


@register("e16_session_load_by_sport", """
SELECT sport, count(*) AS n_sessions, CAST(sum(load) AS BIGINT) AS total_load,
       CAST(sum(duration) AS BIGINT) AS total_minutes FROM v_sessions GROUP BY sport""", views=("v_sessions",))
def e16_session_load_by_sport(spark, sf):
    return views.sessions(spark, sf).groupBy("sport").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.sum("load").cast("bigint").alias("total_load"),
        F.sum("duration").cast("bigint").alias("total_minutes"))


_HRV = "least(100.0, greatest(0.0, (CAST(hrv AS DOUBLE) - 20.0) / 80.0 * 100.0))"
_RHR = "least(100.0, greatest(0.0, (100.0 - CAST(rhr AS DOUBLE)) / 60.0 * 100.0))"
_SLP = ("(CASE WHEN sleep_hours >= 9 THEN 100.0 WHEN sleep_hours >= 7 THEN 75.0 + (sleep_hours - 7.0) / 2.0 * 25.0 "
        "WHEN sleep_hours >= 5 THEN (sleep_hours - 5.0) / 2.0 * 75.0 ELSE 0.0 END)")
_R3 = (f"(CASE WHEN hrv IS NULL OR hrv = 0 OR rhr IS NULL OR rhr = 0 OR sleep_hours IS NULL OR sleep_hours = 0 "
       f"THEN NULL ELSE CAST(floor({_HRV} * 0.4 + {_RHR} * 0.3 + {_SLP} * 0.3 + 0.5) AS BIGINT) END)")
_R4 = (f"CAST(floor({_HRV} * 0.35 + {_RHR} * 0.25 + {_SLP} * 0.25 "
       f"+ greatest(0.0, 100.0 - soreness_score * 10.0) * 0.15 + 0.5) AS BIGINT)")


@register("e9_e14_readiness", "WITH" + _SPINE.rstrip() + f""",
rd AS (SELECT l.athlete_id, l.d, hrv, rhr, sleep_hours, soreness_score, {_R3} AS readiness, {_R4} AS readiness_preview,
              coalesce(r.ratio_pct / 100.0, 0.0) AS ratio
       FROM logs l LEFT JOIN r ON l.athlete_id = r.athlete_id AND l.d = r.d),
rk AS (SELECT *, CASE WHEN readiness IS NULL THEN (CASE WHEN ratio > 1.5 THEN 'High' WHEN ratio > 1.3 THEN 'Medium' ELSE 'Low' END)
                      WHEN readiness < 45 OR ratio > 1.6 THEN 'High'
                      WHEN readiness < 65 OR ratio > 1.3 OR ratio < 0.7 THEN 'Medium' ELSE 'Low' END AS risk
       FROM rd)
SELECT athlete_id, d, hrv, rhr, sleep_hours, soreness_score, readiness, readiness_preview,
  CASE WHEN readiness IS NULL THEN 'No Data' WHEN readiness >= 80 THEN 'Peak Ready' WHEN readiness >= 65 THEN 'Good'
       WHEN readiness >= 45 THEN 'Moderate' ELSE 'Low' END AS readiness_label,
  ratio, risk,
  concat_ws('|', CASE WHEN readiness IS NULL OR readiness = 0 OR readiness < 65 THEN 'Prioritize Sleep' END,
            CASE WHEN ratio > 1.3 THEN 'Reduce Training Load' END,
            CASE WHEN ratio < 0.8 AND ratio > 0 THEN 'Gradual Load Increase' END,
            CASE WHEN risk = 'High' THEN 'Ice & Compression' END,
            CASE WHEN risk = 'High' THEN 'Complete Rest Recommended' END,
            'Hydration', 'Mobility Work', 'Nutrition Timing') AS tips
FROM rk""", views=("v_daily", "v_log_writes"), extra=[_LOGS_SQL])
def e9_e14_readiness(spark, sf):
    t = workload.readiness_table(_daily_logs(spark, sf), _acwr(spark, sf))
    return t.withColumn("tips", F.array_join("tips", "|"))


def _profiles(spark, sf):
    """Latest record per athlete (A2 by date, record id)."""
    r = views.records(spark, sf).select("athlete_id", "date", "record_id", "sport", "position", "age", "weight_kg",
                                        "height_cm", "rest_days", "prior_injuries", "days_since_last_injury")
    return quality.latest_by_key(r, ["athlete_id"], ["date", "record_id"]).drop("date", "record_id")


_J4 = f"""
WITH prof AS (SELECT athlete_id, sport, position, age, weight_kg, height_cm, rest_days, prior_injuries,
                     days_since_last_injury FROM (
        SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY date DESC, record_id DESC) AS rn FROM v_record)
      WHERE rn = 1),
lg AS (SELECT athlete_id, d, hrv, sleep_hours, soreness_score FROM logs
       UNION ALL SELECT athlete_id, DATE '{AS_OF}', NULL, NULL, NULL FROM prof
       WHERE athlete_id NOT IN (SELECT athlete_id FROM logs)),
day AS (SELECT athlete_id, d, count(*) AS n_sessions, sum(duration) AS duration, sum(coalesce(rpe, 5)) AS rpe_sum
        FROM v_sessions GROUP BY athlete_id, d
        UNION ALL
        SELECT athlete_id, d, 0, 0, 0 FROM lg l
        WHERE NOT EXISTS (SELECT 1 FROM v_sessions s WHERE s.athlete_id = l.athlete_id AND s.d = l.d)),
tw AS (SELECT athlete_id, d,
         sum(n_sessions) OVER w AS n7, sum(duration) OVER w AS minutes7, sum(rpe_sum) OVER w AS rpe7
       FROM day WINDOW w AS (PARTITION BY athlete_id ORDER BY d RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)),
j AS (SELECT l.athlete_id, l.d, l.hrv, l.sleep_hours, l.soreness_score, p.sport, p.position, p.age, p.weight_kg,
             p.height_cm, p.rest_days, p.prior_injuries, p.days_since_last_injury, tw.n7, tw.minutes7, tw.rpe7
      FROM lg l LEFT JOIN prof p ON l.athlete_id = p.athlete_id
      LEFT JOIN tw ON l.athlete_id = tw.athlete_id AND l.d = tw.d)
SELECT athlete_id, d AS date, trim(coalesce(sport, 'Football')) AS sport, trim(coalesce(position, 'Midfielder')) AS position,
  least(50.0, greatest(15.0, coalesce(age, 24.0))) AS age,
  least(150.0, greatest(40.0, coalesce(weight_kg, 75.5))) AS weight_kg,
  least(220.0, greatest(140.0, coalesce(height_cm, 178.0))) AS height_cm,
  least(40.0, greatest(0.0, coalesce(CASE WHEN n7 > 0 THEN round(minutes7 / 60.0, 1) END, 14.5))) AS weekly_volume_hrs,
  least(10.0, greatest(0.0, coalesce(CASE WHEN n7 > 0 THEN round(rpe7 / n7, 1) ELSE 7.0 END, 7.5))) AS weekly_intensity_score,
  least(12.0, greatest(0.0, coalesce(sleep_hours, 7.5))) AS sleep_hours,
  least(200.0, greatest(0.0, coalesce(CAST(hrv AS DOUBLE), 58.0))) AS hrv_ms,
  least(10.0, greatest(0.0, coalesce(soreness_score, 4.0))) AS soreness_score,
  CAST(least(7, greatest(0, coalesce(rest_days, 1))) AS INTEGER) AS rest_days,
  CAST(least(20, greatest(0, coalesce(prior_injuries, 2))) AS INTEGER) AS prior_injuries,
  least(10000.0, greatest(0.0, coalesce(days_since_last_injury, 90.0))) AS days_since_last_injury
FROM j"""


@register("j4_f15_build_records", _J4, views=("v_record", "v_sessions", "v_log_writes"), extra=[_LOGS_SQL])
def j4_f15_build_records(spark, sf):
    return workload.build_records(_profiles(spark, sf), _daily_logs(spark, sf), views.sessions(spark, sf), AS_OF)


@register("e10_e12_e13_label_matrix", "WITH" + _SPINE.rstrip() + f""",
rd AS (SELECT l.athlete_id, l.d, {_R3} AS readiness, {_R4} AS readiness_preview, coalesce(r.ratio_pct, 0) AS ratio_pct
       FROM logs l LEFT JOIN r ON l.athlete_id = r.athlete_id AND l.d = r.d)
SELECT {sql_zone('ratio_pct')} AS zone,
  CASE WHEN readiness IS NULL THEN 'No Data' WHEN readiness >= 80 THEN 'Peak Ready' WHEN readiness >= 65 THEN 'Good'
       WHEN readiness >= 45 THEN 'Moderate' ELSE 'Low' END AS readiness_label,
  count(*) AS n_days, round(avg(readiness_preview), 6) AS avg_preview
FROM rd GROUP BY 1, 2""", views=("v_daily", "v_log_writes"), extra=[_LOGS_SQL])
def e10_e12_e13_label_matrix(spark, sf):
    t = workload.readiness_table(_daily_logs(spark, sf))
    a = _acwr(spark, sf).select("athlete_id", "d", "ratio_pct")
    j = t.join(a, ["athlete_id", "d"], "left").withColumn("ratio_pct", F.coalesce("ratio_pct", F.lit(0).cast("bigint")))
    z = workload.with_acwr_zone(j)
    return z.groupBy("zone", "readiness_label").agg(F.count(F.lit(1)).alias("n_days"),
                                                     F.round(F.avg("readiness_preview"), 6).alias("avg_preview"))
