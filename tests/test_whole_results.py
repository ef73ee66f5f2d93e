"""Reports list every athlete, sinks read and write everything, nothing leaks into plans."""
import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadscope.operators import prep, privacy, workload
from loadscope.operators.quantiles import exact_quantiles, sort_key, value_of
from loadscope.session import scratch_path
from loadscope.sources import io

AS_OF = dt.date(2024, 1, 30)


def _sessions(spark):
    day = lambda k: AS_OF - dt.timedelta(days=k)
    rows = [("A", day(1), 60, 7, 420), ("A", day(10), 30, 5, 150), ("idle", day(200), 50, 6, 300)]
    return spark.createDataFrame(rows, "athlete_id string, d date, duration long, rpe long, load long")


@pytest.fixture
def athletes(spark):
    return spark.createDataFrame([("A",), ("idle",), ("new",)], "athlete_id string")


def test_idle_athletes_are_listed(spark, athletes):
    s = _sessions(spark)
    acwr = {r.athlete_id: r for r in workload.acwr_as_of(s, AS_OF, athletes=athletes).collect()}
    assert set(acwr) == {"A", "idle", "new"} and acwr["A"].acute_load == 420
    assert (acwr["idle"].acute_load, acwr["idle"].chronic_load, acwr["idle"].ratio) == (0, 0, 0.0)
    week = {r.athlete_id: r for r in workload.load_summary(s, AS_OF, 7, athletes=athletes).collect()}
    assert (week["new"].n_sessions, week["new"].total_load, week["new"].avg_rpe) == (0, 0, 7.0)
    buckets = workload.weekly_buckets(s, AS_OF, 4, athletes=athletes).collect()
    assert len(buckets) == 12 and sum(r.load for r in buckets) == 570
    daily = s.groupBy("athlete_id", "d").agg(F.sum("load").alias("load"))
    last28 = workload.acwr_daily(daily, start=AS_OF - dt.timedelta(days=27), end=AS_OF, athletes=athletes).collect()
    assert len(last28) == 84 and all(r.ratio == 0 for r in last28 if r.athlete_id != "A")


def test_series_decays_to_the_given_day(spark):
    daily = spark.createDataFrame([("A", AS_OF - dt.timedelta(days=40), 280)], "athlete_id string, d date, load long")
    out = {r.d: r.ratio for r in workload.acwr_daily(daily, through=AS_OF).collect()}
    assert len(out) == 41 and out[AS_OF - dt.timedelta(days=40)] == 4.0 and out[AS_OF] == 0.0


def test_profile_without_log_and_log_without_profile(spark):
    kinds = ("athlete_id string, sport string, position string, age double, weight_kg double, height_cm double, rest_days int, "
             "prior_injuries int, days_since_last_injury double")
    profiles = spark.createDataFrame([("A", "Tennis", "Singles", 20.0, 60.0, 170.0, 1, 0, 10.0),
                                      ("quiet", "Running", "Sprinter", 30.0, 70.0, 180.0, 2, 1, 50.0)], kinds)
    logs = spark.createDataFrame([("A", AS_OF, 60, 7.0, 2.0), ("guest", AS_OF, 50, 6.0, 3.0)],
                                 "athlete_id string, d date, hrv int, sleep_hours double, soreness_score double")
    s = _sessions(spark)
    out = {r.athlete_id: r for r in workload.build_records(profiles, logs, s, AS_OF).collect()}
    assert set(out) == {"A", "quiet", "guest"}
    assert (out["quiet"].date, out["quiet"].hrv_ms, out["quiet"].weekly_intensity_score) == (AS_OF, 58.0, 7.0)
    assert out["guest"].sport == "Football" and out["A"].weekly_volume_hrs == 1.0
    zero = workload.build_records(profiles.withColumn("age", F.lit(0.0)), logs, s, AS_OF, legacy_zero_default=True)
    assert {r.age for r in zero.collect()} == {24.0}


def test_exact_quantiles(spark):
    r = random.Random(1)
    rows = [(r.gauss(0, 1), float(r.randrange(5)), None if i % 3 else float(i)) for i in range(3001)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    got = exact_quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 0.9, 1.0])
    for k, c in enumerate("abc"):
        xs = sorted(x[k] for x in rows if x[k] is not None)
        assert got[c][2] == pytest.approx(statistics.median(xs), abs=1e-12)
        assert (got[c][0], got[c][4]) == (xs[0], xs[-1])
        at = 0.9 * (len(xs) - 1)
        assert got[c][3] == pytest.approx(xs[int(at)] + (at - int(at)) * (xs[int(at) + 1] - xs[int(at)]), abs=1e-12)
    assert exact_quantiles(df.where("a > 100"), ["a"], [0.5]) == {"a": [None]}


def test_radix_keys_sort_as_the_numbers_do(spark):
    xs = [float("-inf"), -1.5e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 1.0, 1.0000000000000002, 1e308, float("inf")]
    keys = sort_key(np.array(xs)).tolist()
    assert keys == sorted(keys) and len(set(keys)) == len(xs) - 1
    assert [value_of(k) for k in keys] == xs
    # Neighbouring doubles differ in the last bits only: all rounds are needed; a third of the rows are one value.
    near = [1.0 + i * 2.0 ** -52 for i in range(500)] + [7.0] * 250
    df = spark.createDataFrame([(x, None) for x in near] + [(float("nan"), None)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.0, 0.4, 0.5, 1.0])
    near.sort()
    assert (got["a"][0], got["a"][2], got["a"][3]) == (near[0], (near[374] + near[375]) / 2, 7.0)
    assert near[299] <= got["a"][1] <= near[300] and got["b"] == [None] * 4


def test_mixed_folder_raises_and_each_format_is_read_whole(spark):
    path = scratch_path(spark, "mixed")
    spark.range(5).write.parquet(path)
    spark.range(3).coalesce(1).write.mode("append").option("header", True).option("compression", "gzip").csv(path)
    with pytest.raises(ValueError, match="several formats"):
        io.read_table(spark, path)
    assert io.read_table(spark, path, fmt="parquet").count() == 5
    assert io.read_table(spark, path, "id bigint", fmt="csv").count() == 3


def test_hot_partition_value_is_written_by_several_tasks(spark):
    path = scratch_path(spark, "hot")
    df = spark.range(400_000, numPartitions=8).select(F.lit("w1").alias("week"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        io.write_table(df, path, partition_by=["week"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    back = spark.read.parquet(path)
    assert back.count() == 400_000 and len(back.inputFiles()) > 1


def test_keys_are_hidden_in_plans(spark):
    key = privacy.derive_aes_key("a secret")
    df = privacy.encrypt_struct(spark.createDataFrame([(1, None)], "a int, b string"), ["a", "b"], "a secret")
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))
    assert key.hex().upper() not in plan.upper()
    back = privacy.decrypt_struct(df, "encrypted_biometrics", "a int, b string", "a secret").first()
    assert back.decrypted.a == 1 and back.decrypted.b is None


def test_one_hot_of_very_many_categories(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("c"), F.col("id").cast("string")).alias("c"))
    params = prep.fit_one_hot(df, ["c"])
    assert params.count() == 2999 and prep.one_hot_long(df, params, "id", ["c"]).count() == 2999


def test_row_policy(spark):
    df = spark.createDataFrame([("A", "Tennis"), ("B", "Tennis"), ("C", "Running")], "athlete_id string, sport string")
    assert [privacy.row_policy(df, r, a, s).count() for r, a, s in
            (("Athlete", "A", None), ("Coach", None, "Tennis"), ("Admin", None, None))] == [1, 2, 3]
