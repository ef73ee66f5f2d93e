"""Registered source/sink (S1-S6, S9, S10) and streaming (Q1-Q5) queries.

Each writes into a fresh folder under the shared ``spark.checkpoint.dir`` and reads the
result back, so the check covers the write path, the read path and the stream engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadscope.operators import metrics, prep, privacy, scoring, workload
from loadscope.plans.q_eval import _CM, _m2_sql
from loadscope.plans.q_scoring import AES_KEY, HMAC_KEY, _e5_sql, _label_sql
from loadscope.plans.q_workload import _LOGS_SQL, _SPINE, AS_OF
from loadscope.plans.registry import register, sql_ratio_pct, sql_zone
from loadscope.session import scratch_path
from loadscope.sources import io, tables, views
from loadscope.streaming import jobs

_REC_COLS = ["record_id", "athlete_id", "date", "sport", "position", "age", "weight_kg", "height_cm", "weekly_volume_hrs",
             "weekly_intensity_score", "sleep_hours", "hrv_ms", "soreness_score", "rest_days", "prior_injuries",
             "days_since_last_injury", "rhr", "injured"]
_REC_SCHEMA = ("record_id bigint, athlete_id string, date date, sport string, position string, age double, weight_kg double, "
               "height_cm double, weekly_volume_hrs double, weekly_intensity_score double, sleep_hours double, hrv_ms double, "
               "soreness_score double, rest_days int, prior_injuries int, days_since_last_injury double, rhr int, injured int")


@register("s1_csv_roundtrip", f"SELECT {', '.join(_REC_COLS)}, CAST(NULL AS VARCHAR) AS _corrupt_record FROM v_record",
          views=("v_record",))
def s1_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "s1-csv")
    views.records(spark, sf).select(*_REC_COLS).write.option("header", True).csv(path)
    return io.read_table(spark, path, _REC_SCHEMA, fmt="csv")


@register("s2_parquet_scan", """
SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_price FROM orders GROUP BY 1""")
def s2_parquet_scan(spark, sf):
    o = io.read_table(spark, f"{sf}/orders.parquet").select("o_orderstatus", "o_totalprice")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"),
                                         F.round(F.sum("o_totalprice"), 2).alias("total_price"))


@register("s3_directory_scan", """
SELECT sport, count(*) AS n_sessions, CAST(sum(load) AS BIGINT) AS total_load FROM v_sessions GROUP BY 1""",
          views=("v_sessions",))
def s3_directory_scan(spark, sf):
    path = scratch_path(spark, "s3-dir")
    views.sessions(spark, sf).repartition(4).write.parquet(path)
    d = io.read_table(spark, path, provenance=True)
    return d.groupBy("sport").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("load").cast("bigint").alias("total_load"))


@register("s4_whole_sink", "SELECT athlete_id, d, n_sessions, load, duration, CAST(date_trunc('week', d) AS DATE) AS week FROM v_daily",
          views=("v_daily",))
def s4_whole_sink(spark, sf):
    path = scratch_path(spark, "s4-whole")
    daily = views.daily(spark, sf).withColumn("week", F.date_trunc("week", "d").cast("date"))
    io.write_table(daily, path, partition_by=["week"], sort_by=["athlete_id", "d"])
    return spark.read.parquet(path).select("athlete_id", "d", "n_sessions", "load", "duration", "week")


@register("s4_partitioned_sink", """
SELECT athlete_id, d, n_sessions, load FROM v_daily WHERE d >= DATE '2024-01-15' AND d < DATE '2024-01-22'""",
          views=("v_daily",))
def s4_partitioned_sink(spark, sf):
    path = scratch_path(spark, "s4-daily")
    daily = views.daily(spark, sf).withColumn("week", F.date_trunc("week", "d").cast("date"))
    io.write_table(daily, path, partition_by=["week"], sort_by=["athlete_id", "d"])
    t = spark.read.parquet(path)
    # The filter on the partition column prunes folders; the one on d is pushed to the scan.
    return t.filter((F.col("week") >= F.lit("2024-01-08").cast("date")) & (F.col("d") >= F.lit("2024-01-15").cast("date"))
                    & (F.col("d") < F.lit("2024-01-22").cast("date"))).select("athlete_id", "d", "n_sessions", "load")


@register("s5_s6_report_sinks", f"WITH cm AS ({_CM.format(t=0.5)}), m AS (" + _m2_sql("cm")
          + ") SELECT *, 'json' AS sink FROM m UNION ALL SELECT *, 'csv' FROM m", views=("v_scored",))
def s5_s6_report_sinks(spark, sf):
    s = views.scored(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    m = metrics.binary_metrics(s, "y", "pred")
    csv_path, json_path = scratch_path(spark, "s5-csv"), scratch_path(spark, "s6-json")
    io.write_report(m, csv_path, "csv")
    io.write_report(m, json_path, "json")
    json_back = spark.read.schema(m.schema).json(json_path).select(*m.columns)
    csv_back = spark.read.schema(m.schema).option("header", True).csv(csv_path).select(*m.columns)
    return json_back.withColumn("sink", F.lit("json")).unionByName(csv_back.withColumn("sink", F.lit("csv")))


@register("s9_audit_append", """
SELECT count(*) AS n_rows, count(DISTINCT athlete_id) AS n_pseudonyms, """ + ", ".join(
    f"round(sum({c})::DOUBLE, 2) AS {c}" for c in privacy.AUDIT_FIELDS if c not in ("sport", "position"))
    + ", count(DISTINCT sport) AS n_sports, count(DISTINCT position) AS n_positions FROM v_record", views=("v_record",))
def s9_audit_append(spark, sf):
    path = scratch_path(spark, "s9-audit")
    scored = scoring.score_formula(views.records(spark, sf))
    even = F.col("record_id") % 2 == 0
    for batch in (scored.where(even), scored.where(~even)):  # two batches, one append each
        io.append_audit(privacy.audit_rows(batch, AES_KEY, HMAC_KEY), path)
    schema = ", ".join(f"{c} {'string' if c in ('sport', 'position') else 'double'}" for c in privacy.AUDIT_FIELDS)
    a = privacy.decrypt_struct(spark.read.parquet(path), "encrypted_biometrics", schema, AES_KEY)
    return a.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("athlete_pseudonym").alias("n_pseudonyms"),
                 *[F.round(F.sum(f"decrypted.{c}"), 2).alias(c) for c in privacy.AUDIT_FIELDS if c not in ("sport", "position")],
                 F.countDistinct("decrypted.sport").alias("n_sports"), F.countDistinct("decrypted.position").alias("n_positions"))


_PCOLS = ["age", "weight_kg", "height_cm", "weekly_volume_hrs", "weekly_intensity_score", "sleep_hours", "hrv_ms",
          "soreness_score", "rest_days", "prior_injuries", "days_since_last_injury"]


@register("s10_params_roundtrip", " UNION ALL ".join(
    [f"SELECT 'median' AS step, '{c}' AS column_name, CAST(NULL AS VARCHAR) AS category, "
     f"round(quantile_cont({c}, 0.5), 6) AS value FROM v_dirty" for c in _PCOLS]
    + [f"SELECT 'mean', '{c}', NULL, round(avg({c}), 6) FROM v_dirty" for c in _PCOLS]
    + [f"SELECT 'std', '{c}', NULL, round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 6) FROM v_dirty"
       for c in _PCOLS]
    + [f"SELECT 'mode', '{c}', (SELECT {c} FROM v_dirty WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), NULL"
       for c in ("sport", "position")]
    + [f"SELECT DISTINCT 'onehot', '{c}', {c}, NULL FROM v_dirty WHERE {c} > (SELECT min({c}) FROM v_dirty)"
       for c in ("sport", "position")]), views=("v_dirty",))
def s10_params_roundtrip(spark, sf):
    d = views.dirty(spark, sf)
    names = ["sport", "position"]
    params = (prep.fit_impute(d, _PCOLS).unionByName(prep.fit_scaler(d, _PCOLS)).unionByName(prep.fit_modes(d, names))
              .unionByName(prep.fit_one_hot(d, names)))
    path = scratch_path(spark, "s10-params")
    io.save_params(params, path)
    back = io.load_params(spark, path)
    return back.select("step", "column_name", "category", F.round("value", 6).alias("value"))


# --------------------------------------------------------------------------- streaming
def _events(spark, sf, root, job):
    """The events in waves of arrival: up to a day late, so that batches overlap in event time."""
    late = F.unix_timestamp(F.col("ts").cast("timestamp")) + (F.col("event_id") % 24) * 3600
    return jobs.in_waves(tables.table(spark, sf, "events"), f"{root}/arrivals", late, job)


def _scored_orders(spark, sf, root):
    customers = jobs.customers(spark, sf)
    return jobs.in_waves(tables.table(spark, sf, "orders"), f"{root}/arrivals", F.col("o_orderkey"),
                         lambda orders: jobs.score_stream(spark, orders, customers, root, HMAC_KEY, AES_KEY))


@register("q1_score_stream", f"""
SELECT record_id, p AS injury_probability, {_label_sql('p')} AS injury_risk_label
FROM (SELECT record_id, {_e5_sql()} AS p FROM v_record)""", views=("v_record",))
def q1_score_stream(spark, sf):
    root = scratch_path(spark, "q1")
    pred, _ = _scored_orders(spark, sf, root)
    return spark.read.parquet(pred).select("record_id", "injury_probability", "injury_risk_label")


@register("q1_audit_stream", """
SELECT athlete_id AS id, count(*) AS n, round(sum(sleep_hours), 2) AS sleep, round(sum(hrv_ms), 2) AS hrv FROM v_record GROUP BY 1""",
          views=("v_record",))
def q1_audit_stream(spark, sf):
    """The audit rows of the stream, decrypted and compared with the records by pseudonym."""
    root = scratch_path(spark, "q1-audit")
    _, audit = _scored_orders(spark, sf, root)
    a = privacy.decrypt_struct(spark.read.parquet(audit), "encrypted_biometrics", "sleep_hours double, hrv_ms double", AES_KEY)
    ids = privacy.pseudonymize(views.records(spark, sf).select("athlete_id").distinct(), "athlete_id", HMAC_KEY)
    return (a.join(ids, "athlete_pseudonym").groupBy(F.col("athlete_id").alias("id"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("decrypted.sleep_hours"), 2).alias("sleep"),
                 F.round(F.sum("decrypted.hrv_ms"), 2).alias("hrv")))


@register("q2_stream_acwr_zones", "WITH" + _SPINE.rstrip() + f"""
SELECT {sql_zone('ratio_pct')} AS zone, count(*) AS athlete_days, CAST(sum(acute) AS BIGINT) AS sum_acute
FROM r GROUP BY 1""", views=("v_daily",))
def q2_stream_acwr_zones(spark, sf):
    root = scratch_path(spark, "q2")
    daily = _events(spark, sf, root, lambda s: jobs.stream_daily_load(spark, s, root))
    return workload.zone_summary(workload.acwr_daily(daily, through=AS_OF))


@register("q2_sliding_acwr", f"""
WITH r AS (SELECT athlete_id, d + k AS d, sum(load) AS chronic28, sum(CASE WHEN k < 7 THEN load ELSE 0 END) AS acute
           FROM v_daily, (SELECT CAST(unnest(range(28)) AS INTEGER) AS k) GROUP BY 1, 2),
     p AS (SELECT *, {sql_ratio_pct('4 * acute', 'chronic28')} AS ratio_pct FROM r
           WHERE d < (SELECT CAST(max(ts) - INTERVAL 2 DAY AS DATE) FROM events))
SELECT athlete_id, CAST(d AS DATE) AS d, CAST(acute AS BIGINT) AS acute, CAST(chronic28 AS BIGINT) AS chronic28,
       CAST(ratio_pct AS BIGINT) AS ratio_pct, {sql_zone('ratio_pct')} AS zone FROM p""", views=("v_daily",))
def q2_sliding_acwr(spark, sf):
    """Every athlete-day that the watermark has closed, two days before the last event."""
    root = scratch_path(spark, "q2-sliding")
    return workload.with_acwr_zone(_events(spark, sf, root, lambda s: jobs.stream_rolling_load(spark, s, root))).drop("zone_hint")


@register("q3_stream_weekly_load", """
SELECT athlete_id, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS week_start,
       count(*) AS n_sessions, CAST(sum(load) AS BIGINT) AS load FROM v_sessions GROUP BY 1, 2""",
          views=("v_sessions",))
def q3_stream_weekly_load(spark, sf):
    root = scratch_path(spark, "q3")
    w = _events(spark, sf, root, lambda s: jobs.stream_weekly_load(spark, s, root))
    return w.select("athlete_id", F.col("week_start").cast("timestamp_ntz").alias("week_start"), "n_sessions",
                    F.col("load").cast("bigint").alias("load"))


@register("q4_stream_upsert_logs", "WITH " + _LOGS_SQL[0] + " AS (" + _LOGS_SQL[1] + ") SELECT * FROM logs",
          views=("v_log_writes",))
def q4_stream_upsert_logs(spark, sf):
    root = scratch_path(spark, "q4")
    _events(spark, sf, root, lambda s: jobs.stream_upsert_logs(spark, s, root))
    merged = spark.read.parquet(jobs.compact_logs(spark, root, f"{root}/merged"))
    return merged.select("athlete_id", "d", "write_id", "ts", "hrv", "rhr", "sleep_hours", "soreness_score")


@register("q4_upsert_table", "WITH " + _LOGS_SQL[0] + " AS (" + _LOGS_SQL[1] + ") SELECT * FROM logs", views=("v_log_writes",))
def q4_upsert_table(spark, sf):
    root = scratch_path(spark, "q4-table")
    table = _events(spark, sf, root, lambda s: jobs.stream_upsert_table(spark, s, root))
    return table.select("athlete_id", "d", "write_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "hrv", "rhr", "sleep_hours", "soreness_score")


@register("q5_admission_flags")
def q5_admission_flags(spark, sf):
    root = scratch_path(spark, "q5")
    by_time = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return jobs.in_waves(tables.table(spark, sf, "events"), f"{root}/arrivals", by_time,
                         lambda s: jobs.admission_flags(s, root, "user_id", "ts", "event_id", limit=5, seconds=3600.0))
