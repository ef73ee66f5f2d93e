import hashlib
import hmac
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from loadscope.functions import fixed
from loadscope.operators import privacy, text
from loadscope.session import scratch_path
from loadscope.sources import views
from loadscope.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_pseudonym_matches_python_hmac(spark):
    ids = ["ATH-1", "ATH-TEST-001", "é-ü"]
    for key in ["k", "x" * 100]:
        df = privacy.pseudonymize(spark.createDataFrame([(i,) for i in ids], "athlete_id string"), "athlete_id", key)
        got = [r.athlete_pseudonym for r in df.collect()]
        want = ["PSN-" + hmac.new(key.encode(), i.encode(), hashlib.sha256).hexdigest()[:12].upper() for i in ids]
        assert got == want


def test_encrypt_roundtrip_and_short_input(spark):
    df = spark.createDataFrame([(12.5, "Rugby")], "v double, sport string")
    e = privacy.encrypt_struct(df, ["v", "sport"], "some key")
    d = privacy.decrypt_struct(e, "encrypted_biometrics", "v double, sport string", "some key").first()
    assert d.decrypted.v == 12.5 and d.decrypted.sport == "Rugby"
    short = spark.createDataFrame([("AAAA",), ("not base64!",)], "c string")
    out = privacy.decrypt_struct(short, "c", "v double", "some key").collect()
    assert all(r.decrypted is None for r in out)


def test_cards_roundtrip(spark):
    df = spark.createDataFrame([(7.0, 65.0, 12.5, 3.0, 75.0, "HIGH")],
                               "sleep_hours double, hrv_ms double, weekly_volume_hrs double, soreness_score double, "
                               "weight_kg double, injury_risk_label string")
    t = text.prescription_text(df)
    c = text.extract_cards(t, "prescription").first()
    assert c.sleep_target == "8.5" and c.sleep_number == "8.5"
    assert c.workload_target == "4.0" and c.therapy_target == "25"
    assert c.nutrition_target == "26g protein + 800ml" and c.nutrition_number == "26"
    assert c.detail_text == ""


def test_card_fields_match_the_lazy_pattern(spark):
    """Against a lazy match up to the next key, on texts of random parts: keys in mid-line, blank, repeated, missing."""
    rng = random.Random(7)
    parts = ["SLEEP_TARGET:", "SLEEP_TARGET: 8.5h", "SLEEP_DETAIL: a b", "\n", "\n\n", "more text", " ", "NOTE: x", "see SLEEP_TARGET: 7",
             "WORKLOAD_TARGET:\t4", "lower: y", "THERAPY_HEADLINE:", "\x01", "NUTRITION_DETAIL: é\nü", "\n---DETAIL---\n", "_:", "A_SLEEP_TARGET: 1"]
    texts = ["", "\n"] + ["".join(rng.choice(parts) + rng.choice(["", "\n", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    names = [f"{k}_{x}" for k in fixed.CARD_KEYS for x in ("HEADLINE", "TARGET", "DETAIL")]

    def field(body: str, name: str) -> str:
        m = re.search(name + r":[ \t\n\f\r]*(.+?)(?=\n[A-Z_]+:|\Z)", body, re.S)
        return m[1].strip(" \t\n\f\r") if m else ""

    for r in text.extract_cards(df).collect():
        body, _, tail = texts[r.i].partition("---DETAIL---")
        assert [r[n.lower()] for n in names] == [field(body, n) for n in names], texts[r.i]
        assert r.detail_text == tail.strip(" \t\n\f\r")
    none = text.extract_cards(spark.createDataFrame([(1, None)], "i int, text string")).first()
    assert none.sleep_target is None and none.detail_text == ""


def test_prompts_of_a_record(spark):
    rec = dict(athlete_id="ATH-1", sport="Rugby", position="Wing", age=24.0, weight_kg=75.0, height_cm=178.0, weekly_volume_hrs=12.5,
               weekly_intensity_score=7.2, sleep_hours=9.0, hrv_ms=65.0, soreness_score=3.0, rest_days=1, prior_injuries=2,
               days_since_last_injury=90.0, injury_probability=0.7585, injury_risk_label="HIGH",
               top_contributing_factors=["a", "b (10%)", "c", "d", "e"])
    df = spark.createDataFrame([rec, rec | {"sleep_hours": 7.0, "injury_risk_label": "LOW", "position": None}])
    out = {t: text.prompt_table(df, t).select("system", "prompt").collect() for t in ("recovery", "tips", "cards", "full")}
    first = {t: rows[0].prompt for t, rows in out.items()}
    assert "Predicted Injury Probability: 75.8%" in first["recovery"] and first["recovery"].count("a, b (10%), c, d, e") == 1
    assert "(76% probability)" in first["tips"] and "drivers: a, b (10%), c\n" in first["tips"]
    assert "by +0.0h tonight" in first["cards"] and "Cap RPE at 4.0/10" in first["cards"] and "[26g protein" in first["cards"]
    assert "Sleep adequate" in first["full"] and "26g + 750ml" in first["full"] and "THERAPY_TARGET: 25\n" in first["full"]
    second = out["full"][1].prompt
    assert "deficit detected → extend by +1.5h tonight" in second and "SLEEP_TARGET: 8.5\n" in second and "26g + 600ml" in second
    assert all(r.system.startswith("You are a") and "{" not in r.prompt for rows in out.values() for r in rows)


def test_assemble_text_order(spark):
    rows = [(1, s, f"<{s}>") for s in range(2500)] + [(2, 1, "b"), (2, 0, "a")]
    df = spark.createDataFrame(rows, "id long, seq long, content string")
    out = {r.id: r.text for r in text.assemble_text(df, bucket=100).collect()}
    assert out[1] == "".join(f"<{s}>" for s in range(2500)) and out[2] == "ab"


def _brute(events: pd.DataFrame, limit: int, seconds: float) -> dict:
    flags = {}
    for _, g in events.sort_values(["ts", "event_id"]).groupby("user_id"):
        log = []
        for eid, ts in zip(g.event_id, g.ts):
            t = ts.timestamp()
            log = [x for x in log if x > t - seconds]
            ok = len(log) < limit
            if ok:
                log.append(t)
            flags[eid] = ok
    return flags


def test_admission_flags_vs_brute_force(spark):
    """Four micro-batches in order of time: the log of a key lives from one to the next."""
    root = scratch_path(spark, "t-q5")
    events = spark.read.parquet(f"{SF}/events.parquet")
    path = jobs.arrivals(events, f"{root}/arrivals", F.unix_timestamp(F.col("ts").cast("timestamp")))
    flags = jobs.admission_flags(jobs.file_stream(spark, path, max_files=1), root, "user_id", "ts", "event_id", limit=2, seconds=6 * 3600.0)
    got = {r.event_id: r.allowed for r in flags.collect()}
    ev = events.select("event_id", "user_id", "ts").toPandas()
    ev["ts"] = pd.to_datetime(ev["ts"]).dt.tz_localize("UTC")
    assert got == _brute(ev, 2, 6 * 3600.0)
    assert 0 < sum(not v for v in got.values()) < len(got)


def test_admission_of_a_busy_key_late_rows_and_nulls(spark):
    """A key with most rows runs in several tasks; a restarted job goes on from the admitted times."""
    rows = [("hot", i, (i // 8) * 100.0 + i % 8) for i in range(4000)] + [(f"k{i % 50}", 4000 + i, i * 1.7) for i in range(1000)]
    rows += [(None, 9000 + i, 5.0) for i in range(4)]
    timed = spark.createDataFrame(rows, "user_id string, event_id long, s double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    flat = timed.select(F.col("user_id").alias("key"), "event_id", F.unix_micros("ts").alias("t"), F.lit(False).alias("carried"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = jobs.admit(flat, 3, 60.0).where("key = 'hot'").select(F.spark_partition_id()).distinct().count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks > 4

    root = scratch_path(spark, "t-q5-hot")
    flags = {}
    for part in (timed.where("ts < timestamp_seconds(25003)"), timed.where("ts >= timestamp_seconds(25003)")):
        jobs.arrivals(part, f"{root}/arrivals", F.unix_timestamp("ts"), files=2)
        out = jobs.admission_flags(jobs.file_stream(spark, f"{root}/arrivals", max_files=1), root, "user_id", "ts", "event_id", 3, 60.0)
        flags = {r.event_id: r.allowed for r in out.collect()}
    ev = timed.selectExpr("event_id", "coalesce(user_id, '-') AS user_id", "ts").toPandas()
    assert flags == _brute(ev, 3, 60.0) and len(flags) == 5004

    late = spark.createDataFrame([("hot", 9100, 40003.5), ("hot", 9101, 3.5), ("x", 9102, None), ("hot", 9103, 39990.0)], "user_id string, event_id long, s double")
    late.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(f"{root}/arrivals")
    out = jobs.admission_flags(jobs.file_stream(spark, f"{root}/arrivals", max_files=1), root, "user_id", "ts", "event_id", 3, 60.0)
    new = {r.event_id: r.allowed for r in out.where("event_id > 9099").collect()}
    assert new == {9100: False, 9101: False, 9102: None, 9103: True}  # three came in the window before 9100 and 9101


def test_rolling_load_appends_final_days_once(spark):
    """Sums of the stream equal the batch series on every closed day, and a restart repeats none."""
    root = scratch_path(spark, "t-rolling")
    events = spark.read.parquet(f"{SF}/events.parquet")
    when = F.unix_timestamp(F.col("ts").cast("timestamp"))
    middle = events.select(when.alias("s")).approxQuantile("s", [0.6], 0)[0]
    for part in (events.where(when < middle), events.where(when >= middle)):
        jobs.arrivals(part, f"{root}/arrivals", when, files=2)
        got = jobs.stream_rolling_load(spark, jobs.file_stream(spark, f"{root}/arrivals", max_files=1), root)
    daily = views.sessions_of(events).groupBy("athlete_id", "d").agg(F.sum("load").alias("load"))
    last = events.agg(F.max("ts").alias("t")).first().t
    closed = (last - pd.Timedelta(days=2)).date()
    want = {}
    for r in daily.collect():
        for k in range(28):
            day = r.d + pd.Timedelta(days=k)
            if day < closed:
                a, c = want.get((r.athlete_id, day), (0, 0))
                want[r.athlete_id, day] = (a + r.load * (k < 7), c + r.load)
    rows = got.collect()
    assert len(rows) == len({(r.athlete_id, r.d) for r in rows})
    assert {(r.athlete_id, r.d): (r.acute, r.chronic28) for r in rows} == want


def test_stream_stops_and_resumes(spark):
    """The second run reads only what is new and its days merge with those of the first."""
    root = scratch_path(spark, "t-resume")
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").limit(400).cache()
    when = F.unix_timestamp(F.col("ts").cast("timestamp"))
    half = events.approxQuantile("event_id", [0.5], 0)[0]
    for part in (events.where(F.col("event_id") < half), events.where(F.col("event_id") >= half)):
        jobs.arrivals(part, f"{root}/arrivals", when, files=2)
        days = jobs.stream_daily_load(spark, jobs.file_stream(spark, f"{root}/arrivals", max_files=1), root, watermark="60 days")
    want = views.sessions_of(events).groupBy("athlete_id", "d").agg(F.sum("load").alias("load"))
    assert sorted(map(tuple, days.select("athlete_id", "d", "load").collect())) == sorted(map(tuple, want.collect()))
    assert jobs.written(spark, f"{root}/days").select("batch_id").distinct().count() == 4


def test_upsert_rewrites_the_days_of_a_batch_only(spark, tmp_path):
    import datetime as dt
    import os

    from loadscope.streaming import jobs
    src, root = str(tmp_path / "src"), str(tmp_path / "root")

    def arrive(rows):
        spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(src)
        out = jobs.stream_upsert_table(spark, jobs.file_stream(spark, src, max_files=1), root)
        return {(r.athlete_id, str(r.d)): r.write_id for r in out.collect()}

    def files():
        return {d: sorted(os.listdir(f"{root}/table/{d}")) for d in os.listdir(f"{root}/table") if d.startswith("d=")}

    day = lambda d, h: dt.datetime(2024, 1, d, h)
    first = arrive([(1, 7, day(1, 8)), (2, 7, day(2, 8)), (3, 8, day(2, 9)), (2, 7, day(2, 8))])
    assert first == {("ATH-7", "2024-01-01"): 1, ("ATH-7", "2024-01-02"): 2, ("ATH-8", "2024-01-02"): 3}
    before = files()
    second = arrive([(4, 7, day(2, 12)), (5, 9, day(3, 1)), (3, 8, day(2, 9))])
    assert second == first | {("ATH-7", "2024-01-02"): 4, ("ATH-9", "2024-01-03"): 5}
    after = files()
    assert after["d=2024-01-01"] == before["d=2024-01-01"] and after["d=2024-01-02"] != before["d=2024-01-02"]
    again = jobs.stream_upsert_table(spark, jobs.file_stream(spark, src, max_files=1), root)
    assert files() == after and again.count() == 4


def test_a_wave_of_many_files_is_one_micro_batch(spark):
    """A large table has many files a wave, in no order of time: as micro-batches of their own, all but the first of a
    wave would be late, and their number would grow with the table."""
    events = spark.read.parquet(f"{SF}/events.parquet").repartition(6)
    when = F.unix_timestamp(F.col("ts").cast("timestamp"))
    root, batches = scratch_path(spark, "t-waves"), []
    job = lambda s: jobs.run(s, root, lambda b, i: batches.append(b.select(F.count(F.lit(1)), F.min("event_id")).first()[0]))
    jobs.in_waves(events, f"{root}/arrivals", when, job)
    assert len(batches) == jobs.FILES and sum(batches) == events.count() and max(batches) < 2 * min(batches)
    assert spark.read.parquet(f"{root}/arrivals").inputFiles().__len__() > jobs.FILES

    root = scratch_path(spark, "t-waves-late")
    got = jobs.in_waves(events, f"{root}/arrivals", when, lambda s: jobs.stream_weekly_load(spark, s, root, watermark="1 hour"))
    assert got.agg(F.sum("n_sessions")).first()[0] == events.count()
