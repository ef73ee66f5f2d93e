"""Structured Streaming versions of the continuous operators (Q1-Q5).

* Sources are file streams; any other streaming source with the same schema works unchanged.
  ``in_waves`` writes a table in order of arrival and lets a job take each part as it arrives, one
  micro-batch a part whatever the number of its files; ``arrivals`` writes all parts for a job that reads by files.
* Every job takes a ``root`` folder under the shared file system and keeps its sink and its
  checkpoint there, so a job started again with the same root goes on where it stopped.
* Each micro-batch writes a folder of its own (``batch_id=N``, overwritten if the batch is
  repeated), so a batch that was interrupted and run again is in the sink once.
* Aggregating streams (Q2, Q3) run in ``update`` mode; the read side is an A2 "last write wins" over
  (key, batch id). State is bounded by the watermark; no state is kept in complete mode.
* Rolling 7/28-day load (Q2) comes in two forms. ``stream_daily_load`` keeps only day-grain state in the stream;
  the calendar ratios are the batch W5 operator over that day table. ``stream_rolling_load`` chains sliding
  windows over the day windows, so that the stream itself appends each athlete-day once, when it is final.
* Q4 is a log of reduced writes, merged when it is read (``compact_logs`` merges it for good), or a table
  in folders by day into which each micro-batch is merged (``stream_upsert_table``).
* Q5 (sliding-log admission) is sequential per key only while the key is busy: a micro-batch is cut where a key
  pauses for the length of the window, so a hot key's runs spread over the tasks, which keyed state would not do.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadscope.functions.rounding import ratio_pct
from loadscope.operators import privacy, quality, scoring
from loadscope.sources import tables, views

FILES = 4


# --------------------------------------------------------------------------- sources
def waves(df: DataFrame, order: Column, parts: int = FILES) -> Iterator[DataFrame]:
    """``df`` as ``parts`` tables of about equal size in ascending order of the number ``order``."""
    keyed = df.withColumn("_at", order.cast("double"))
    bounds = keyed.approxQuantile("_at", [i / parts for i in range(1, parts)], 0.001)
    lo = None
    for hi in [*bounds, None]:
        part = keyed if lo is None else keyed.where(F.col("_at") >= lo)
        yield (part if hi is None else part.where(F.col("_at") < hi)).drop("_at")
        lo = hi


def arrivals(df: DataFrame, path: str, order: Column, files: int = FILES) -> str:
    """Writes ``df`` as ``files`` appends of about equal size in ascending order of the number ``order``."""
    for part in waves(df, order, files):
        part.write.mode("append").parquet(path)
    return path


T = TypeVar("T")


def in_waves(df: DataFrame, path: str, order: Column, job: Callable[[DataFrame], T], parts: int = FILES) -> T:
    """Appends ``df`` to ``path`` in ``parts`` waves, each followed by ``job`` over the stream of the folder, which goes
    on where it stopped; returns what the last run does.

    A large table has many files a wave, in no order of time: taken one by one they would be as many
    micro-batches, and rows of the later ones late."""
    out = None
    for part in waves(df, order, parts):
        part.write.mode("append").parquet(path)
        out = job(file_stream(df.sparkSession, path, max_files=None))
    return out


def file_stream(spark: SparkSession, path: str, max_files: int | None = 8, glob: str | None = None) -> DataFrame:
    """A folder of Parquet files as a stream of at most ``max_files`` files a micro-batch (None: all that are there)."""
    r = spark.readStream.schema(spark.read.parquet(path if glob is None else f"{path.rstrip('/')}/{glob}").schema)
    if max_files is not None:
        r = r.option("maxFilesPerTrigger", max_files)
    return (r if glob is None else r.option("pathGlobFilter", glob)).parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream."""
    return file_stream(spark, sf_dir, glob=f"{name}.parquet")


def run(stream: DataFrame, root: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything available now, micro-batch by micro-batch; resumes from the checkpoint in ``root``."""
    q = (stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").outputMode(mode).trigger(availableNow=True)
         .foreachBatch(write).start())
    q.awaitTermination()


def sink(path: str, change: Callable[[DataFrame], DataFrame] = lambda b: b) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: one folder a batch, written over if the batch is repeated."""
    def write(batch: DataFrame, batch_id: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def written(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a sink, with their ``batch_id``."""
    return spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("bigint"))


# --------------------------------------------------------------------------- Q1
def score_stream(spark: SparkSession, orders: DataFrame, customers: DataFrame, root: str, hmac_key: str, aes_key: str) -> tuple[str, str]:
    """Q1: score each arriving record (stream-static join with the customer dimension) once, and write
    its prediction and its audit row (S9). Returns (prediction path, audit path)."""
    predictions, audit = f"{root}/predictions", f"{root}/audit"

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = scoring.top_factors(scoring.score_formula(batch)).persist()
        sink(predictions, lambda b: b.select("record_id", "athlete_id", "injury_probability", "injury_risk_label",
                                             "top_contributing_factors"))(scored, batch_id)
        sink(audit, lambda b: privacy.audit_rows(b, aes_key, hmac_key))(scored, batch_id)
        scored.unpersist()

    run(views.records_of(orders, customers), root, write)
    return predictions, audit


# --------------------------------------------------------------------------- Q2 / Q3
def _sessions(events: DataFrame, watermark: str) -> DataFrame:
    """Watermarks refuse TIMESTAMP_NTZ: the event time is cast to TIMESTAMP."""
    return views.sessions_of(events.withColumn("ts", F.col("ts").cast("timestamp"))).withWatermark("ts", watermark)


def stream_daily_load(spark: SparkSession, events: DataFrame, root: str, watermark: str = "2 days") -> DataFrame:
    """Q2 state: day-grain load per athlete (tumbling 1-day windows, watermark-bounded state). Returns
    the merged day table (batch DataFrame). Events later than the watermark are dropped."""
    g = _sessions(events, watermark).groupBy("athlete_id", F.window("ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("n_sessions"), F.sum("load").alias("load"), F.sum("duration").alias("duration"))
    g = g.select("athlete_id", F.to_date(F.col("w.start")).alias("d"), "n_sessions", "load", "duration")
    run(g, root, sink(f"{root}/days"), "update")
    return quality.latest_by_key(written(spark, f"{root}/days"), ["athlete_id", "d"], ["batch_id"]).drop("batch_id")


def stream_rolling_load(spark: SparkSession, events: DataFrame, root: str, watermark: str = "2 days") -> DataFrame:
    """Q2 inside the stream: 7- and 28-day sums and the calendar ratio of each athlete-day, appended once the
    watermark has passed the day's end. Day windows are final first and feed 28-day windows that slide by a day, so
    an event is in one day's state and only a day's sum in 28. A day with no load in its 28 days has no row.

    Events later than the watermark are dropped."""
    days = _sessions(events, watermark).groupBy("athlete_id", F.window("ts", "1 day").alias("day")).agg(F.sum("load").alias("load"))
    days = days.select("athlete_id", F.window_time("day").alias("at"), "load")
    sliding = days.select("athlete_id", "at", "load", F.window("at", "28 days", "1 day").alias("w"))
    recent = F.col("at") >= F.col("w.end") - F.expr("INTERVAL 7 DAYS")
    sums = sliding.groupBy("athlete_id", "w").agg(F.sum(F.when(recent, F.col("load")).otherwise(0)).cast("bigint").alias("acute"),
                                                  F.sum("load").cast("bigint").alias("chronic28"))
    ratio = ratio_pct(F.lit(4) * F.col("acute"), F.col("chronic28")).alias("ratio_pct")
    run(sums.select("athlete_id", F.date_sub(F.to_date("w.end"), 1).alias("d"), "acute", "chronic28", ratio), root, sink(f"{root}/rolling"))
    return written(spark, f"{root}/rolling").drop("batch_id")


def stream_weekly_load(spark: SparkSession, events: DataFrame, root: str, watermark: str = "2 days") -> DataFrame:
    """Q3: tumbling 7-day windows (epoch-aligned) of session load per athlete."""
    g = _sessions(events, watermark).groupBy("athlete_id", F.window("ts", "7 days").alias("w")).agg(
        F.count(F.lit(1)).alias("n_sessions"), F.sum("load").alias("load"))
    g = g.select("athlete_id", F.col("w.start").alias("week_start"), "n_sessions", "load")
    run(g, root, sink(f"{root}/weeks"), "update")
    return quality.latest_by_key(written(spark, f"{root}/weeks"), ["athlete_id", "week_start"], ["batch_id"]).drop("batch_id")


# --------------------------------------------------------------------------- Q4
_LOG_KEY, _LOG_ORDER = ["athlete_id", "d"], ["ts", "write_id"]


def stream_upsert_logs(spark: SparkSession, events: DataFrame, root: str) -> DataFrame:
    """Q4: daily-log writes, last write wins per (athlete, day). Each micro-batch is reduced with A2
    before it is logged; the read side applies A2 across batches."""
    run(views.log_writes_of(events), root, sink(f"{root}/logs", lambda b: quality.latest_by_key(b, _LOG_KEY, _LOG_ORDER)))
    return quality.latest_by_key(written(spark, f"{root}/logs").drop("batch_id"), _LOG_KEY, _LOG_ORDER)


def stream_upsert_table(spark: SparkSession, events: DataFrame, root: str) -> DataFrame:
    """Q4 as a true upsert: one table in folders by day, one row per (athlete, day). A micro-batch reads and
    replaces the folders of its own days only (dynamic partition overwrite); exact repeats within the
    watermark are dropped first. The merge takes the last write, so a batch that runs again changes nothing."""
    table = f"{root}/table"
    writes = views.log_writes_of(events.withColumn("ts", F.col("ts").cast("timestamp")))
    writes = writes.withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["write_id"])
    where = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        merged = batch
        if files.exists(where):
            days = [r.d for r in batch.select("d").distinct().collect()]  # the batch's days: folders to be replaced
            merged = batch.sparkSession.read.schema(batch.schema).parquet(table).where(F.col("d").isin(days)).select(*batch.columns).unionByName(batch)
        (quality.latest_by_key(merged, _LOG_KEY, _LOG_ORDER).repartition("d").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("d").parquet(table))
        batch.unpersist()

    run(writes, root, write)
    return spark.read.parquet(table)


def compact_logs(spark: SparkSession, root: str, target: str) -> str:
    """Merges the log into one table, one row per (athlete, day), in folders by day."""
    from loadscope.sources import io
    merged = quality.latest_by_key(written(spark, f"{root}/logs").drop("batch_id"), _LOG_KEY, _LOG_ORDER)
    io.write_table(merged, target, partition_by=["d"], sort_by=["athlete_id"])
    return target


# --------------------------------------------------------------------------- Q5
def busy_runs(rows: DataFrame, micros: int) -> DataFrame:
    """Adds ``run`` to rows with ``key`` and time ``t`` (microseconds): rows of a key share a run while each lies
    less than ``micros`` after the one before, so that no window of that length spans two runs.

    Rows of one slot of ``micros`` are closer than that to each other, so runs can only end between slots: they
    are found on (key, slot) extremes, and no task orders the rows of a whole key."""
    slotted = rows.withColumn("slot", F.floor(F.col("t") / micros).cast("bigint"))
    slots = slotted.groupBy("key", "slot").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    w = Window.partitionBy("key").orderBy("slot")
    first = F.coalesce(F.col("lo") - F.lag("hi").over(w) >= micros, F.lit(True))
    starts = (slots.select("key", "slot", F.when(first, F.col("slot")).alias("start"))
              .select(F.col("key").alias("_key"), F.col("slot").alias("_slot"), F.max("start").over(w).alias("run")))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("slot") == F.col("_slot"))
    return slotted.join(starts, same).drop("slot", "_key", "_slot")


def _admit(limit: int, micros: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Decides rows that come ordered by (key, run, time); holds the admitted times of the last window only."""
    def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, log = None, deque()
        for frame in frames:
            allowed = []
            for key, run, t, carried in zip(frame["key"], frame["run"], frame["t"], frame["carried"]):
                if (key, run) != here:
                    here, log = (key, run), deque()
                while log and log[0] <= t - micros:
                    log.popleft()
                allowed.append(bool(carried) or len(log) < limit)
                if allowed[-1]:
                    log.append(t)
            yield frame.drop(columns="run").assign(allowed=allowed)
    return fn


def admit(rows: DataFrame, limit: int, seconds: float) -> DataFrame:
    """``allowed`` for rows (key, event_id, t, carried) in order of time; carried rows were admitted before. A key's
    runs spread over the tasks, and a task reads its runs as ordered batches."""
    micros = round(seconds * 1e6)
    ordered = (busy_runs(rows, micros).select("key", "event_id", "t", "carried", "run").repartition("key", "run")
               .sortWithinPartitions("key", "run", "t", F.desc("carried"), "event_id"))
    return ordered.mapInPandas(_admit(limit, micros), "key string, event_id long, t long, carried boolean, allowed boolean")


def admission_flags(stream: DataFrame, root: str, key: str, ts: str, event_id: str, limit: int = 5, seconds: float = 60.0,
                    watermark: str = "1 day") -> DataFrame:
    """Q5: flag each request: allowed if fewer than ``limit`` admitted requests of the same key lie in
    the last ``seconds``; refused requests do not count. Returns the flags.

    Requests of a micro-batch are taken by event time, equal times by ``event_id``. A micro-batch leaves the
    admitted times that a request up to ``watermark`` late can still see in ``root/admitted/batch_id=N``; the next
    one starts from them. A request that comes late is judged by what was admitted before its own time; flags
    already given stay. A null key is a key of its own; a request without a time has no flag (null)."""
    s = stream.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("long").alias("event_id"),
                      F.col(ts).cast("timestamp").alias("ts"))
    spark = stream.sparkSession
    columns = ["key", "event_id", "t", "carried"]
    files = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(batch: DataFrame, batch_id: int) -> None:
        timed = batch.where("ts IS NOT NULL").select("key", "event_id", F.unix_micros("ts").alias("t"), F.lit(False).alias("carried"))
        before = f"{root}/admitted/batch_id={batch_id - 1}"
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(before)):
            kept = batch.sparkSession.read.schema("key string, event_id long, t long").parquet(before)
            timed = timed.unionByName(kept.select("key", "event_id", "t", F.lit(True).alias("carried")).select(*columns))
        done = admit(timed, limit, seconds).persist()
        new = done.where("NOT carried").select("key", "event_id", F.timestamp_micros("t").alias("ts"), "allowed")
        untimed = batch.where("ts IS NULL").select("key", "event_id", "ts", F.lit(None).cast("boolean").alias("allowed"))
        sink(f"{root}/flags")(new.unionByName(untimed), batch_id)
        since = F.unix_micros(F.timestamp_micros(F.max("t")) - F.expr(f"INTERVAL {watermark}")) - round(seconds * 1e6)
        cut = done.agg(since.alias("since")).first().since
        sink(f"{root}/admitted")(done.where(F.col("allowed") & (F.col("t") > F.lit(cut))).select("key", "event_id", "t"), batch_id)
        done.unpersist()

    run(s, root, write)
    return written(spark, f"{root}/flags").drop("batch_id")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
