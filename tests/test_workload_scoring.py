import datetime as dt

from pyspark.sql import functions as F

from loadscope.functions import scores
from loadscope.operators import scoring, workload

REC = ["athlete_id", "sport", "position", "weekly_volume_hrs", "weekly_intensity_score", "sleep_hours", "hrv_ms",
       "soreness_score", "rest_days", "prior_injuries", "days_since_last_injury"]
SCHEMA = ("athlete_id string, sport string, position string, weekly_volume_hrs double, weekly_intensity_score double, "
          "sleep_hours double, hrv_ms double, soreness_score double, rest_days int, prior_injuries int, "
          "days_since_last_injury double")


def test_readiness_goldens(spark):
    df = spark.createDataFrame([(60, 65, 7.5), (45, 60, 6.0), (38, 70, 4.5), (0, 60, 7.0)],
                               "hrv int, rhr int, sleep_hours double")
    out = [r.r for r in df.select(scores.readiness3().alias("r")).collect()]
    assert out == [62, 44, 24, None]


def test_score_formula_goldens(spark):
    rows = [("ATH-TEST-001", "Football", "Midfielder", 12.5, 7.2, 7.5, 65.0, 3.0, 1, 2, 90.0),
            ("ATH-103", "Basketball", "Point Guard", 22.5, 9.5, 5.0, 38.0, 8.5, 0, 3, 21.0),
            ("ATH-104", "Tennis", "Singles", 16.0, 7.8, 6.5, 48.0, 6.0, 1, 1, 60.0),
            ("ATH-102", "Running", "Marathoner", 18.0, 8.8, 8.2, 74.0, 2.5, 1, 1, 140.0)]
    out = scoring.score_formula(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.injury_probability for r in out] == [0.6553, 0.9353, 0.6623, 0.6729]
    assert {r.injury_risk_label for r in out} == {"HIGH"}


def test_position_fallback_order(spark):
    df = spark.createDataFrame([("Midfielder",), ("Forward",), ("Spin Bowler",), ("Singles",), ("",), (None,)],
                               "position string")
    out = [r.m for r in df.select(scoring.position_multiplier(F.col("position")).alias("m")).collect()]
    assert out == [1.15, 1.20, 1.00, 1.0, 1.0, 1.0]


def test_risk_label_edges(spark):
    df = spark.createDataFrame([(0.30,), (0.3001,), (0.60,), (0.61,), (None,), (1.5,)], "p double")
    out = [r.l for r in df.select(scores.risk_label("p").alias("l")).collect()]
    assert out == ["LOW", "MEDIUM", "MEDIUM", "HIGH", None, None]


def test_absent_columns_use_defaults_null_gives_null(spark):
    df = spark.createDataFrame([("A", None)], "athlete_id string, sleep_hours double")
    r = scoring.score_formula(df).first()
    assert r.injury_probability is None and r.injury_risk_label is None
    r2 = scoring.score_formula(spark.createDataFrame([("A",)], "athlete_id string")).first()
    assert r2.injury_probability is not None


def test_top_factors_default_and_order(spark):
    rows = [("A", "Tennis", "Singles", 5.0, 1.0, 8.0, 80.0, 1.0, 3, 0, 400.0),
            ("B", "Cricket", "Fast Bowler", 20.0, 8.0, 6.0, 40.0, 7.0, 0, 2, 30.0)]
    out = scoring.top_factors(spark.createDataFrame(rows, SCHEMA)).orderBy("athlete_id").collect()
    assert out[0].top_contributing_factors == ["Workload within safe threshold", "Normal recovery baseline"]
    assert out[1].top_contributing_factors == ["High-Impact Sport Position (Fast Bowler in Cricket)",
                                               "High Weekly Intensity (8.0/10)", "Elevated Weekly Volume (20.0 hrs)"]


def _daily(spark, rows):
    return spark.createDataFrame(rows, "athlete_id string, d date, load bigint")


def test_acwr_daily_gap_filled_and_zero(spark):
    d0 = dt.date(2024, 1, 1)
    df = _daily(spark, [("A", d0, 100), ("A", d0 + dt.timedelta(days=40), 50), ("Z", d0, 0)])
    out = workload.acwr_daily(df).collect()
    a = sorted([r for r in out if r.athlete_id == "A"], key=lambda r: r.d)
    assert len(a) == 41  # every calendar day from first to last
    assert a[0].ratio == 4.0 and a[0].acute == 100  # D21: short history starts at 4.0
    assert a[30].acute == 0 and a[30].ratio == 0.0
    z = [r for r in out if r.athlete_id == "Z"]
    assert z[0].ratio == 0.0


def test_acwr_as_of_excludes_future(spark):
    rows = [("A", dt.datetime(2024, 1, 30, 10), dt.date(2024, 1, 30), 70),
            ("A", dt.datetime(2024, 1, 10, 10), dt.date(2024, 1, 10), 70),
            ("A", dt.datetime(2024, 2, 5, 10), dt.date(2024, 2, 5), 999)]
    s = spark.createDataFrame(rows, "athlete_id string, ts timestamp_ntz, d date, load bigint")
    r = workload.acwr_as_of(s, "2024-01-30").first()
    assert (r.acute_load, r.chronic_load, r.ratio) == (70, 35, 2.0)


def test_exact_tenths_prints_as_python(spark):
    from loadscope.functions.rounding import exact_tenths
    values = [i / 10000 * 100.0 for i in range(10001)] + [0.05, 0.25, 0.35, 2.675, 99.95, 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.t for r in df.select(exact_tenths(F.col("x")).alias("t")).collect()] == [f"{v:.1f}" for v in values]
