"""Athlete-domain tables derived from the driver tables.

The driver ships TPC-H-like tables; these views re-read them as the studied system's data
model (sessions, daily loads, athlete records, scored rows, discomfort entries, text
chunks). Each is a lazy DataFrame over the whole table, so its work grows with the data.
The DuckDB twin of every view lives in ``loadscope.plans.oracle_views`` (same arithmetic,
integers where sums are compared).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscope.functions import fixed
from loadscope.sources.tables import table


def _case(col: Column, pairs, default=None) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workout sessions: one per event (E16 load = duration x rpe, integers)."""
    return sessions_of(table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type"))


def sessions_of(ev: DataFrame) -> DataFrame:
    """Sessions of events, batch or stream."""
    k = F.col("event_id")
    duration = (F.lit(30) + k % 70)
    rpe = (F.lit(4) + k % 5)
    return ev.select(
        k.alias("session_id"),
        F.concat(F.lit("ATH-"), F.col("user_id").cast("string")).alias("athlete_id"),
        F.col("ts"),
        F.to_date("ts").alias("d"),
        _case(F.col("event_type"), fixed.EVENT_TYPE_SPORT, "Fitness Training").alias("sport"),
        duration.alias("duration"),
        rpe.alias("rpe"),
        (duration * rpe).alias("load"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day grain per athlete. Partial aggregation runs map-side, so a hot athlete's
    sessions collapse to at most one row per day before the shuffle."""
    return (sessions(spark, sf_dir)
            .groupBy("athlete_id", "d")
            .agg(F.count(F.lit(1)).alias("n_sessions"),
                 F.sum("load").alias("load"),
                 F.sum("duration").alias("duration")))


def athletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every athlete: all customers, and all users that have events."""
    c = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("k"))
    e = table(spark, sf_dir, "events", "user_id").select(F.col("user_id").alias("k"))
    return c.union(e).distinct().select(F.concat(F.lit("ATH-"), F.col("k").cast("string")).alias("athlete_id"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Athlete records (AthleteRecord schema + rhr), one per order."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
              "o_orderpriority")
    return records_of(o, table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"))


def records_of(o: DataFrame, c: DataFrame) -> DataFrame:
    """Records of orders (batch or stream) and customers."""
    k = F.col("o_orderkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return j.select(
        k.alias("record_id"),
        F.concat(F.lit("ATH-"), F.col("o_custkey").cast("string")).alias("athlete_id"),
        F.to_date("o_orderdate").alias("date"),
        _case(F.col("c_mktsegment"), fixed.SEGMENT_SPORT, "Fitness Training").alias("sport"),
        _case(F.col("o_orderpriority"), fixed.PRIORITY_POSITION, "").alias("position"),
        (F.lit(15) + k % 36).cast("double").alias("age"),
        (F.lit(40) + k % 111).cast("double").alias("weight_kg"),
        (F.lit(140) + k % 81).cast("double").alias("height_cm"),
        ((k % 401).cast("double") / F.lit(10.0)).alias("weekly_volume_hrs"),
        ((k % 101).cast("double") / F.lit(10.0)).alias("weekly_intensity_score"),
        ((k % 121).cast("double") / F.lit(10.0)).alias("sleep_hours"),
        ((k * 7) % 201).cast("double").alias("hrv_ms"),
        (((k * 3) % 101).cast("double") / F.lit(10.0)).alias("soreness_score"),
        (k % 8).cast("int").alias("rest_days"),
        (k % 21).cast("int").alias("prior_injuries"),
        ((k * 13) % 400).cast("double").alias("days_since_last_injury"),
        (F.lit(40) + k % 61).cast("int").alias("rhr"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("int").alias("injured"),
    )


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training table: records + injured target."""
    return records(spark, sf_dir)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with nulls, out-of-range values, malformed ids and exact duplicate rows."""
    r = records(spark, sf_dir)
    k = F.col("record_id")
    r = r.select(
        "record_id",
        F.when(k % 23 == 0, F.concat(F.lit(" ath#"), F.col("athlete_id").substr(5, 20), F.lit("<x> ")))
         .otherwise(F.col("athlete_id")).alias("athlete_id"),
        "date",
        F.when(k % 31 == 0, F.lit(None).cast("string")).otherwise(F.col("sport")).alias("sport"),
        "position",
        F.when(k % 29 == 0, F.lit(200.0)).otherwise(F.col("age")).alias("age"),
        "weight_kg", "height_cm", "weekly_volume_hrs", "weekly_intensity_score",
        F.when(k % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("sleep_hours")).alias("sleep_hours"),
        F.when(k % 19 == 0, F.lit(None).cast("double")).otherwise(F.col("hrv_ms")).alias("hrv_ms"),
        "soreness_score", "rest_days", "prior_injuries", "days_since_last_injury", "rhr",
        F.when(k % 37 == 0, F.lit(None).cast("int")).otherwise(F.col("injured")).alias("injured"),
    )
    return r.unionByName(r.filter(k % 50 == 0))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: label y and two deterministic score columns with many ties."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("int").alias("y"),
        ((k % 997).cast("double") / F.lit(997.0)).alias("p"),
        (((k * 31) % 983).cast("double") / F.lit(983.0)).alias("p2"),
    )


def discomfort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discomfort entries in long form: (athlete_id, d, zone, severity>0); the strongest
    report per zone and day wins."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    zones = F.array(*[F.lit(z) for z in fixed.BODY_ZONES])
    return (ev.select(F.concat(F.lit("ATH-"), F.col("user_id").cast("string")).alias("athlete_id"),
                      F.to_date("ts").alias("d"),
                      F.element_at(zones, (F.col("event_id") % 19 + 1).cast("int")).alias("zone"),
                      (F.col("event_id") % 4).cast("int").alias("severity"))
            .filter(F.col("severity") > 0)
            .groupBy("athlete_id", "d", "zone").agg(F.max("severity").alias("severity")))


def log_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily-log writes (hrv, rhr, sleep, soreness): every event is also a log write for its
    athlete and day; the daily log is the last write per (athlete, day) (A2)."""
    return log_writes_of(table(spark, sf_dir, "events", "event_id", "ts", "user_id"))


def log_writes_of(ev: DataFrame) -> DataFrame:
    """Daily-log writes of events, batch or stream."""
    k = F.col("event_id")
    return ev.select(
        k.alias("write_id"),
        F.concat(F.lit("ATH-"), F.col("user_id").cast("string")).alias("athlete_id"),
        F.col("ts"),
        F.to_date("ts").alias("d"),
        (F.lit(20) + (k * 7) % 81).cast("int").alias("hrv"),
        (F.lit(40) + (k * 3) % 41).cast("int").alias("rhr"),
        (F.lit(4.0) + (k % 61).cast("double") / F.lit(10.0)).alias("sleep_hours"),
        (((k * 11) % 101).cast("double") / F.lit(10.0)).alias("soreness_score"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return c.select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), "role",
                    F.col("text").alias("content"))


def daily_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-filled day grain per athlete (first to last active day) with the wide-table
    measures: total_km, z5_km (rpe >= 7), sprint_km (rpe = 8), exertion (mean rpe) and
    recovery (mean of 1 + session_id % 9); injury = a severe discomfort report that day.
    Inactive days: 0 km, NULL exertion/recovery."""
    s = sessions(spark, sf_dir)
    g = s.groupBy("athlete_id", "d").agg(
        F.count(F.lit(1)).alias("n_sessions"),
        (F.sum("duration") / F.lit(10.0)).alias("total_km"),
        (F.sum(F.when(F.col("rpe") >= 7, F.col("duration")).otherwise(0)) / F.lit(10.0)).alias("z5_km"),
        (F.sum(F.when(F.col("rpe") == 8, F.col("duration")).otherwise(0)) / F.lit(20.0)).alias("sprint_km"),
        F.avg(F.col("rpe").cast("double")).alias("exertion"),
        F.avg((F.lit(1) + F.col("session_id") % 9).cast("double")).alias("recovery"))
    b = g.groupBy("athlete_id").agg(F.min("d").alias("_lo"), F.max("d").alias("_hi"))
    spine = b.select("athlete_id", F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias("d"))
    inj = (discomfort(spark, sf_dir).filter(F.col("severity") == 3)
           .select("athlete_id", "d").distinct().withColumn("_inj", F.lit(1)))
    return (spine.join(g, ["athlete_id", "d"], "left").join(inj, ["athlete_id", "d"], "left")
            .select("athlete_id", "d",
                    F.coalesce("n_sessions", F.lit(0).cast("bigint")).alias("n_sessions"),
                    F.coalesce("total_km", F.lit(0.0)).alias("total_km"),
                    F.coalesce("z5_km", F.lit(0.0)).alias("z5_km"),
                    F.coalesce("sprint_km", F.lit(0.0)).alias("sprint_km"),
                    "exertion", "recovery",
                    F.coalesce("_inj", F.lit(0)).cast("int").alias("injury")))


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-sectional player table (one row per record) for E4 / forest training."""
    r = records(spark, sf_dir)
    return r.select(
        "record_id",
        F.col("age").alias("Player_Age"), F.col("weight_kg").alias("Player_Weight"),
        F.col("height_cm").alias("Player_Height"),
        F.col("prior_injuries").alias("Previous_Injuries"),
        (F.col("weekly_intensity_score") / F.lit(10.0)).alias("Training_Intensity"),
        F.col("rest_days").alias("Recovery_Time"),
        F.col("injured").alias("Likelihood_of_Injury"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-policy users: every customer is a user; custkey % 10 = 0 -> Coach of the
    customer's segment sport, 1 -> Medical Staff, 2 -> Admin, else Athlete with own id."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    role = (F.when(k % 10 == 0, "Coach").when(k % 10 == 1, "Medical Staff").when(k % 10 == 2, "Admin")
            .otherwise("Athlete"))
    return c.select(F.concat(F.lit("user"), k.cast("string")).alias("username"), role.alias("role"),
                    F.when(role == "Athlete", F.concat(F.lit("ATH-"), k.cast("string"))).alias("athlete_id"),
                    F.when(role == "Coach", _case(F.col("c_mktsegment"), fixed.SEGMENT_SPORT, "Fitness Training"))
                    .alias("sport"))
