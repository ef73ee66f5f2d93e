"""Workload analytics over sessions and daily logs.

Scale notes
-----------
* Everything is keyed by athlete. Session tables are first reduced to day grain with a
  map-side-combined ``groupBy(athlete, day)``: a hot athlete (a third of all sessions)
  becomes at most one row per day before any athlete-partitioned window, so the largest
  window partition is bounded by the number of days, not sessions.
* Calendar spines are bounded by each athlete's own first and last day (or the requested
  range) and generated with ``explode(sequence(...))`` — no cross join.
* "As of" dates are parameters, never ``current_date()``; range filters are stated on the raw
  timestamp column with matching type so they reach the parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscope.functions import scores
from loadscope.functions.rounding import int_div, ratio_pct, round_js


#: Mean exertion of a week without sessions.
IDLE_RPE = 7.0


def _date(d) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d))


def _ts_bounds(df: DataFrame, lo: dt.date, hi: dt.date) -> DataFrame:
    """Filter [lo, hi] calendar days; stated on ``ts`` too (same type) for scan pushdown."""
    out = df.filter((F.col("d") >= F.lit(lo)) & (F.col("d") <= F.lit(hi)))
    if "ts" in df.columns:
        ts_type = df.schema["ts"].dataType.simpleString()
        lo_ts = F.lit(dt.datetime.combine(lo, dt.time())).cast(ts_type)
        hi_ts = F.lit(dt.datetime.combine(hi + dt.timedelta(days=1), dt.time())).cast(ts_type)
        out = out.filter((F.col("ts") >= lo_ts) & (F.col("ts") < hi_ts))
    return out


def day_number(d: Column) -> Column:
    """Days since epoch: a numeric ordering key for RANGE frames over dates."""
    return F.unix_date(d)


# --------------------------------------------------------------------------- W5
def day_spine(daily: DataFrame, key: str = "athlete_id", day: str = "d",
              start=None, end=None) -> DataFrame:
    """One row per (key, day) from each key's own first to last day, or [start, end]."""
    if start is not None and end is not None:
        keys = daily.select(key).distinct()
        lo, hi = F.lit(_date(start)), F.lit(_date(end))
        return keys.select(key, F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 DAY"))).alias(day))
    b = daily.groupBy(key).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    return b.select(key, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias(day))


def acwr_daily(daily: DataFrame, key: str = "athlete_id", day: str = "d", load: str = "load",
               start=None, end=None, through=None, athletes: DataFrame | None = None) -> DataFrame:
    """Calendar ACWR series per athlete, inactive days included.

    Without ``start``/``end`` a series runs from the athlete's first session to the last one, or to
    ``through`` if that is later, so that it decays after the last session. With both, every athlete
    of ``athletes`` (default: of ``daily``) has one row for each day of [start, end], 0 where idle.

    acute = sum(load, [d-6, d]); chronic = sum(load, [d-27, d]) / 4 (JS-rounded for display);
    ratio = round_half_up(acute / chronic, 2), 0 when chronic is 0 (D2, D21).
    Input is day grain (``v_daily``)."""
    sums = daily.select(key, day, F.col(load).cast("bigint").alias("_load"))
    if start is not None and end is not None:
        lo = _date(start) - dt.timedelta(days=27)
        sums = sums.filter((F.col(day) >= F.lit(lo)) & (F.col(day) <= F.lit(_date(end))))
    if start is None or end is None:
        # Gap filling without a spine join: each active day emits itself and the inactive
        # days up to the next active day (``lead``). The window partitioning by athlete is
        # the one the range windows below need, so no further exchange is planned.
        wl = Window.partitionBy(key).orderBy(day_number(F.col(day)))
        nxt = sums.withColumn("_next", F.lead(day).over(wl))
        last = F.col(day) if through is None else F.greatest(F.col(day), F.lit(_date(through)))
        gen = nxt.select(key, F.col(day).alias("_active"), "_load",
                         F.explode(F.sequence(F.col(day), F.coalesce(F.date_sub("_next", 1), last),
                                              F.expr("INTERVAL 1 DAY"))).alias(day))
        filled = gen.select(key, day, F.when(F.col(day) == F.col("_active"), F.col("_load"))
                            .otherwise(F.lit(0).cast("bigint")).alias("_load"))
    else:
        spine = day_spine(daily if athletes is None else athletes, key, day, start, end)
        filled = (spine.join(sums, [key, day], "left")
                  .select(key, day, F.coalesce("_load", F.lit(0).cast("bigint")).alias("_load")))
    if start is not None and end is not None:
        # Days before `start` only feed the windows; keep them in the frame, drop later.
        hist = sums.filter(F.col(day) < F.lit(_date(start)))
        filled = filled.unionByName(hist)
    w = Window.partitionBy(key).orderBy(day_number(F.col(day)))
    acute = F.sum("_load").over(w.rangeBetween(-6, 0))
    chronic28 = F.sum("_load").over(w.rangeBetween(-27, 0))
    out = filled.select(key, day, "_load", acute.alias("acute"), chronic28.alias("chronic28"))
    if start is not None and end is not None:
        out = out.filter(F.col(day) >= F.lit(_date(start)))
    pct = F.coalesce(ratio_pct(F.lit(4) * F.col("acute"), F.col("chronic28")), F.lit(0).cast("bigint"))
    return out.select(
        key, day,
        F.col("_load").alias("load"),
        F.col("acute").cast("bigint").alias("acute"),
        int_div(F.col("chronic28") + 2, F.lit(4)).alias("chronic"),
        (pct / F.lit(100.0)).alias("ratio"),
        pct.alias("ratio_pct"),
    )


def with_acwr_zone(df: DataFrame, pct: str = "ratio_pct") -> DataFrame:
    """E12 label + hint from the ratio in hundredths."""
    return df.withColumn("zone", scores.acwr_zone(F.col(pct))) \
             .withColumn("zone_hint", scores.acwr_zone_hint(F.col(pct)))


def zone_summary(acwr: DataFrame) -> DataFrame:
    """Athlete-days and acute load per ACWR zone."""
    return (with_acwr_zone(acwr).groupBy("zone")
            .agg(F.count(F.lit(1)).alias("athlete_days"), F.sum("acute").cast("bigint").alias("sum_acute")))


# --------------------------------------------------------------------------- W4
def _athletes(sessions: DataFrame, athletes: DataFrame | None, key: str) -> DataFrame:
    """The athletes that a report lists: the given ones, else all that ever had a session."""
    return (sessions if athletes is None else athletes).select(key).distinct()


def acwr_as_of(sessions: DataFrame, as_of, key: str = "athlete_id", athletes: DataFrame | None = None) -> DataFrame:
    """Point-in-time calendar ACWR: conditional sums over [as_of-27, as_of]; future
    sessions excluded (D2). Athletes idle in the window have load and ratio 0."""
    a = _date(as_of)
    s = _ts_bounds(sessions, a - dt.timedelta(days=27), a)
    in7 = F.col("d") >= F.lit(a - dt.timedelta(days=6))
    g = s.groupBy(key).agg(
        F.sum(F.when(in7, F.col("load")).otherwise(0)).cast("bigint").alias("acute_load"),
        F.sum("load").cast("bigint").alias("load28"))
    g = _athletes(sessions, athletes, key).join(g, key, "left").fillna(0, ["acute_load", "load28"])
    pct = F.coalesce(ratio_pct(F.lit(4) * F.col("acute_load"), F.col("load28")), F.lit(0).cast("bigint"))
    return g.select(key, "acute_load", int_div(F.col("load28") + 2, F.lit(4)).alias("chronic_load"),
                    (pct / F.lit(100.0)).alias("ratio"), pct.alias("ratio_pct"))


# --------------------------------------------------------------------------- A11-A14
def load_summary(sessions: DataFrame, as_of, days: int = 7, key: str = "athlete_id",
                 athletes: DataFrame | None = None) -> DataFrame:
    """Trailing-window session aggregates per athlete; without a session in the window the
    sums are 0 and the mean exertion is the default."""
    a = _date(as_of)
    s = _ts_bounds(sessions, a - dt.timedelta(days=days - 1), a)
    g = s.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.sum("load").cast("bigint").alias("total_load"),
        (F.sum("duration") / F.lit(60.0)).alias("volume_hrs"),
        F.avg(F.coalesce(F.col("rpe"), F.lit(5))).alias("avg_rpe"))
    return (_athletes(sessions, athletes, key).join(g, key, "left")
            .fillna(0, ["n_sessions", "total_load", "volume_hrs"]).fillna(IDLE_RPE, ["avg_rpe"]))


def lifetime_summary(sessions: DataFrame, logs: DataFrame, key: str = "athlete_id") -> DataFrame:
    """Lifetime totals per athlete; days tracked = number of daily logs."""
    s = sessions.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.sum("load").cast("bigint").alias("total_load"),
        round_js(F.avg("duration")).cast("bigint").alias("avg_duration"),
        (round_js(F.avg("rpe") * 10.0) / F.lit(10.0)).alias("avg_rpe"))
    lg = logs.groupBy(key).agg(F.count(F.lit(1)).alias("days_tracked"))
    return (s.join(lg, key, "full")
            .select(key, F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"),
                    F.coalesce("total_load", F.lit(0).cast("bigint")).alias("total_load"),
                    "avg_duration", "avg_rpe",
                    F.coalesce("days_tracked", F.lit(0)).alias("days_tracked")))


def daily_load(daily: DataFrame, as_of, days: int = 7, key: str = "athlete_id",
               athletes: DataFrame | None = None) -> DataFrame:
    """Per athlete, each of the last `days` days zero-filled, with bar percent of the
    window's max (max floored at 1)."""
    a = _date(as_of)
    lo = a - dt.timedelta(days=days - 1)
    w = daily.filter((F.col("d") >= F.lit(lo)) & (F.col("d") <= F.lit(a))).select(key, "d", "load")
    spine = _athletes(daily, athletes, key).select(
        key, F.explode(F.sequence(F.lit(lo), F.lit(a), F.expr("INTERVAL 1 DAY"))).alias("d"))
    filled = spine.join(w, [key, "d"], "left").select(
        key, "d", F.coalesce("load", F.lit(0).cast("bigint")).alias("load"))
    mx = F.greatest(F.max("load").over(Window.partitionBy(key)), F.lit(1))
    return filled.select(key, "d", "load", round_js(F.col("load") * 100.0 / mx).cast("bigint").alias("bar_pct"))


def weekly_buckets(sessions: DataFrame, as_of, weeks: int = 4, key: str = "athlete_id",
                   athletes: DataFrame | None = None) -> DataFrame:
    """Consecutive 7-day buckets back from as_of (0 = most recent), zero-filled for every
    athlete."""
    a = _date(as_of)
    s = _ts_bounds(sessions, a - dt.timedelta(days=7 * weeks - 1), a)
    b = int_div(F.datediff(F.lit(a), F.col("d")), F.lit(7)).alias("week_back")
    g = s.groupBy(key, b).agg(F.sum("load").cast("bigint").alias("load"),
                              F.count(F.lit(1)).alias("n_sessions"))
    spine = (_athletes(sessions, athletes, key)
             .select(key, F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("_w"))
             .select(key, F.col("_w").cast("bigint").alias("week_back")))
    return spine.join(g, [key, "week_back"], "left").select(
        key, "week_back", F.coalesce("load", F.lit(0).cast("bigint")).alias("load"),
        F.coalesce("n_sessions", F.lit(0).cast("bigint")).alias("n_sessions"))


# --------------------------------------------------------------------------- A16, A17
def discomfort_daily(disc: DataFrame, key: str = "athlete_id") -> DataFrame:
    """A16 per day: number of affected zones and the sorted zone list."""
    return disc.groupBy(key, "d").agg(
        F.count(F.lit(1)).alias("affected_zones"),
        F.max("severity").alias("max_severity"),
        F.array_join(F.array_sort(F.collect_list("zone")), ",").alias("zones"))


def zone_recurrence(disc: DataFrame, key: str = "athlete_id") -> DataFrame:
    """A16 per zone: days reported and severity counts."""
    return disc.groupBy(key, "zone").agg(
        F.count(F.lit(1)).alias("days_reported"),
        F.sum(F.when(F.col("severity") == 1, 1).otherwise(0)).alias("n_mild"),
        F.sum(F.when(F.col("severity") == 2, 1).otherwise(0)).alias("n_moderate"),
        F.sum(F.when(F.col("severity") == 3, 1).otherwise(0)).alias("n_severe"))


def discomfort_nested(disc: DataFrame, key: str = "athlete_id") -> DataFrame:
    """Long form -> one row per (athlete, day) with ``regions array<struct<zone,severity>>``."""
    return disc.groupBy(key, "d").agg(
        F.array_sort(F.collect_list(F.struct("zone", "severity"))).alias("regions"))


def completion_flags(logs: DataFrame, daily: DataFrame, key: str = "athlete_id") -> DataFrame:
    """For every athlete-day with a log or a workout: has_log, has_workout."""
    lg = logs.select(key, "d", F.lit(1).alias("_log"))
    wk = daily.select(key, "d", F.lit(1).alias("_wk"))
    return lg.join(wk, [key, "d"], "full").select(
        key, "d", F.col("_log").isNotNull().alias("has_log"), F.col("_wk").isNotNull().alias("has_workout"))


# --------------------------------------------------------------------------- readiness
def readiness_table(logs: DataFrame, acwr: DataFrame | None = None, key: str = "athlete_id") -> DataFrame:
    """E9/E10/E13 per daily log, plus E11/E14 when a day-level ACWR is given."""
    out = logs.select(key, "d", "hrv", "rhr", "sleep_hours", "soreness_score",
                      scores.readiness3("hrv", "rhr", "sleep_hours").alias("readiness"),
                      scores.readiness4("hrv", "rhr", "sleep_hours", "soreness_score").alias("readiness_preview"))
    out = out.withColumn("readiness_label", scores.readiness_label("readiness"))
    if acwr is not None:
        out = out.join(acwr.select(key, "d", "ratio"), [key, "d"], "left") \
                 .withColumn("ratio", F.coalesce("ratio", F.lit(0.0))) \
                 .withColumn("risk", scores.rule_risk("readiness", "ratio")) \
                 .withColumn("tips", scores.recovery_tips("readiness", "ratio", "risk"))
    return out


# --------------------------------------------------------------------------- J4 / F15
def trailing_week(daily: DataFrame, key: str = "athlete_id") -> DataFrame:
    """Per active day: sessions, minutes and rpe-sum over [d-6, d] (range window on day grain)."""
    w = Window.partitionBy(key).orderBy(day_number(F.col("d"))).rangeBetween(-6, 0)
    return daily.select(key, "d",
                        F.sum("n_sessions").over(w).alias("n7"),
                        F.sum("duration").over(w).alias("minutes7"),
                        F.sum("rpe_sum").over(w).alias("rpe7"))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def build_records(profiles: DataFrame, logs: DataFrame, sessions: DataFrame, as_of,
                  key: str = "athlete_id", legacy_zero_default: bool = False) -> DataFrame:
    """J4 + F15: one AthleteRecord per daily log, and one dated ``as_of`` per profile without any
    log: profile (latest per athlete) joined with that day's log and the trailing-7-day workout
    aggregates; values clamped into the legal ranges with defaults on NULL (or on 0 as well with
    ``legacy_zero_default``, D22). A log without a profile takes the default profile."""
    unlogged = (profiles.select(key).join(logs.select(key).distinct(), key, "left_anti")
                .withColumn("d", F.lit(_date(as_of))))
    logs = logs.unionByName(unlogged, allowMissingColumns=True)
    day = (sessions.groupBy(key, "d")
           .agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("duration").alias("duration"),
                F.sum(F.coalesce("rpe", F.lit(5))).alias("rpe_sum")))
    # Days with a log but no session still need the trailing window: add them with zeros.
    day = day.unionByName(
        logs.select(key, "d").join(day.select(key, "d"), [key, "d"], "left_anti")
        .select(key, "d", F.lit(0).cast("bigint").alias("n_sessions"),
                F.lit(0).cast("bigint").alias("duration"), F.lit(0).cast("bigint").alias("rpe_sum")))
    tw = trailing_week(day, key)
    j = logs.join(profiles, key, "left").join(tw, [key, "d"], "left")

    def dflt(c: Column, v) -> Column:
        if legacy_zero_default:
            c = F.when(c != 0, c)
        return F.coalesce(c, F.lit(v))

    vol = F.when(F.col("n7") > 0, F.round(F.col("minutes7") / 60.0, 1))
    inten = F.when(F.col("n7") > 0, F.round(F.col("rpe7") / F.col("n7"), 1)).otherwise(F.lit(IDLE_RPE))
    return j.select(
        key, F.col("d").alias("date"),
        F.trim(F.coalesce("sport", F.lit("Football"))).alias("sport"),
        F.trim(F.coalesce("position", F.lit("Midfielder"))).alias("position"),
        clamp(dflt(F.col("age"), 24.0), 15.0, 50.0).alias("age"),
        clamp(dflt(F.col("weight_kg"), 75.5), 40.0, 150.0).alias("weight_kg"),
        clamp(dflt(F.col("height_cm"), 178.0), 140.0, 220.0).alias("height_cm"),
        clamp(dflt(vol, 14.5), 0.0, 40.0).alias("weekly_volume_hrs"),
        clamp(dflt(inten, 7.5), 0.0, 10.0).alias("weekly_intensity_score"),
        clamp(dflt(F.col("sleep_hours"), 7.5), 0.0, 12.0).alias("sleep_hours"),
        clamp(dflt(F.col("hrv").cast("double"), 58.0), 0.0, 200.0).alias("hrv_ms"),
        clamp(dflt(F.col("soreness_score"), 4.0), 0.0, 10.0).alias("soreness_score"),
        clamp(F.coalesce(F.col("rest_days"), F.lit(1)), 0, 7).cast("int").alias("rest_days"),
        clamp(dflt(F.col("prior_injuries"), 2), 0, 20).cast("int").alias("prior_injuries"),
        clamp(dflt(F.col("days_since_last_injury"), 90.0), 0.0, 10000.0).alias("days_since_last_injury"),
    )
