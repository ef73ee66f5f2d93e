import pytest
from pyspark.sql import functions as F

from loadscope.functions import fixed
from loadscope.operators import quality


def test_required_columns(spark):
    df = spark.createDataFrame([tuple([1] * len(fixed.TRAINING_COLUMNS))], fixed.TRAINING_COLUMNS)
    quality.require_columns(df, fixed.TRAINING_COLUMNS)
    with pytest.raises(ValueError, match="Missing required columns"):
        quality.require_columns(df.drop("injured"), fixed.TRAINING_COLUMNS)


def test_dedup_and_report(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (2, 20)], "a int, b int")
    assert quality.dedup(df).count() == 2
    r = quality.dedup_report(df).first()
    assert (r.rows_before, r.rows_after, r.removed) == (3, 2, 1)


def test_drop_null_target(spark):
    df = spark.createDataFrame([(1, 0), (None, None)], "a int, injured int")
    assert quality.drop_null_target(df, "injured").filter(F.col("injured").isNull()).count() == 0


def test_validate_ranges_and_text(spark):
    rec = dict(athlete_id="ATH-TEST-001", date="2026-07-24", sport="Football", position="Midfielder", age=24.0,
               weight_kg=75.5, height_cm=178.0, weekly_volume_hrs=12.5, weekly_intensity_score=7.2, sleep_hours=7.5,
               hrv_ms=65.0, soreness_score=3.0, rest_days=1, prior_injuries=2, days_since_last_injury=90.0)
    bad = dict(rec, age=200.0)
    evil = dict(rec, athlete_id="ATH-<script>alert(1)</script>")
    df = spark.createDataFrame([rec, bad, evil])
    v = quality.validate(df).select("age", "is_valid", "violations").collect()
    assert [r.is_valid for r in v] == [True, False, True]
    assert v[1].violations == ["age:range"]
    t = quality.validate_text(df).select("id_ok", "text_ok", "date_ok").collect()
    assert [r.id_ok for r in t] == [True, True, False]
    assert all(r.text_ok and r.date_ok for r in t)


def test_repair_athlete_id(spark):
    df = spark.createDataFrame([("ATH-7",), (" 12 3 ",), ("",), (None,), ("<>",)], "athlete_id string")
    out = [r.athlete_id for r in quality.repair_athlete_id(df).collect()]
    assert out == ["ATH-7", "ATH-123", "ATH-101", "ATH-101", "ATH-101"]


def test_latest_by_key_hot_key(spark):
    rows = [("a", i, i * 10) for i in range(1000)] + [("b", 1, 5)]
    df = spark.createDataFrame(rows, "k string, seq int, v int")
    out = {r.k: (r.seq, r.v) for r in quality.latest_by_key(df, ["k"], ["seq"]).collect()}
    assert out == {"a": (999, 9990), "b": (1, 5)}


def test_describe_and_modes(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (3.0, "y"), (4.0, "x")], "v double, c string")
    d = quality.describe_numeric(df, ["v"]).first()
    assert (d.p25, d.p50, d.p75) == (1.75, 2.5, 3.25)  # linear interpolation, like pandas
    m = quality.modes(df, ["c"]).first()
    assert m.mode == "x" and m.freq == 2  # tie -> smallest value


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    h = {r.bucket: r.n for r in quality.histogram(df, "v", 5).collect()}
    assert h == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}
