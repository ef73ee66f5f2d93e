import datetime as dt

from loadscope.operators import features


def test_recovery_score_and_flags(spark):
    df = spark.createDataFrame(
        [("A1", dt.date(2026, 1, 1), 7.0, 60.0, 3.0, 1, 3, 20.0, 10.0),
         ("A1", dt.date(2026, 1, 8), 8.0, 70.0, 2.0, 2, 1, 100.0, 12.0)],
        "athlete_id string, date date, sleep_hours double, hrv_ms double, soreness_score double, rest_days int, "
        "prior_injuries int, days_since_last_injury double, weekly_volume_hrs double")
    out = features.add_injury_history_features(features.add_recovery_score(df)).orderBy("date").collect()
    assert [round(r.recovery_score, 6) for r in out] == [0.525, 0.6875]
    assert [r.high_injury_history for r in out] == [1, 0]
    assert [r.recent_injury for r in out] == [1, 0]


def test_acwr_rows_and_rolling_std(spark):
    loads = [10, 12, 8, 0, 14, 10, 9, 11]
    df = spark.createDataFrame([("A", dt.date(2026, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(loads)],
                               "athlete_id string, date date, weekly_volume_hrs double")
    a = features.acwr_rows(df).orderBy("date").collect()
    assert abs(a[7].acwr - 0.98841699) < 1e-8
    assert a[0].acwr == 1.0
    r = features.rolling_stats(df, cols=("weekly_volume_hrs",), windows=(7,)).orderBy("date").collect()
    assert r[0].weekly_volume_hrs_roll7_std == 0.0
    assert abs(r[1].weekly_volume_hrs_roll7_std - 1.41421356) < 1e-8
    # sample std of rows 2..8 = sqrt(120.857.../6) = 4.4880794493 (statistics.stdev agrees)
    assert abs(r[7].weekly_volume_hrs_roll7_std - 4.4880794493) < 1e-9


def test_zero_chronic_gives_one(spark):
    df = spark.createDataFrame([("A", dt.date(2026, 1, 1), 0.0), ("A", dt.date(2026, 1, 2), 0.0)],
                               "athlete_id string, date date, weekly_volume_hrs double")
    assert {r.acwr for r in features.acwr_rows(df).collect()} == {1.0}


def test_zscore_single_row_is_null_and_constant_is_zero(spark):
    df = spark.createDataFrame([("A", dt.date(2026, 1, 1), 5.0), ("B", dt.date(2026, 1, 1), 3.0),
                                ("B", dt.date(2026, 1, 2), 3.0)], "athlete_id string, d date, x double")
    z = {(r.athlete_id, r.d): r.x_ath_zscore for r in features.athlete_zscore(df, ["x"]).collect()}
    assert z[("A", dt.date(2026, 1, 1))] is None
    assert z[("B", dt.date(2026, 1, 2))] == 0.0


def test_one_large_athlete_spans_blocks(spark, monkeypatch):
    rows = [("hot", dt.date(2020, 1, 1) + dt.timedelta(days=i // 2), i, float((i * 37) % 23), float(i % 5)) for i in range(700)]
    rows += [(f"A{j}", dt.date(2020, 1, 1) + dt.timedelta(days=i), 1000 + 40 * j + i, float(i), 1.0) for j in range(6) for i in range(30)]
    rows += [(None, dt.date(2020, 1, 1) + dt.timedelta(days=i), 5000 + i, float(i % 7), 2.0) for i in range(90)]
    df = spark.createDataFrame(rows, "athlete_id string, date date, n int, weekly_volume_hrs double, weekly_intensity_score double").repartition(5)
    order = ("date", "n")
    whole = [sorted(map(str, f(df, order=order).collect())) for f in (features.acwr_rows, features.rolling_stats)]
    monkeypatch.setattr(features, "BLOCK_ROWS", 64)
    cut = [sorted(map(str, f(df, order=order).collect())) for f in (features.acwr_rows, features.rolling_stats)]
    assert whole == cut and len(whole[0]) == len(rows)
    blocks = features.time_blocks(df, "athlete_id", list(order), 27)
    sizes = [r["count"] for r in blocks.where("athlete_id = 'hot'").groupBy("_block").count().collect()]
    assert max(sizes) == 64 + 27
    assert blocks.where("athlete_id = 'hot' and not _halo").select("_block").distinct().count() == 11
    assert blocks.where("not _halo").count() == len(rows)
