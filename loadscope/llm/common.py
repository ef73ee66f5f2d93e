"""Helpers shared by the operators: shared scratch tables, whole-order positions, links to components.

Scratch tables are Parquet folders under the folder named by ``spark.checkpoint.dir``, so a lost
executor costs a re-run of its tasks and never a table. Every operator projects the columns it
needs to names of its own first, so extra columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

import gc
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadscope.session import scratch_path

#: Words: runs of anything but these white-space characters (Java and Python pattern).
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


#: Rows of an Arrow batch at most: rows carry texts, shingle sets or token ids, and a batch stands in memory
#: on both sides of each of an executor's Python workers.
BATCH_ROWS = 500


def with_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver found it, whatever folder the driver
    runs in, and keeps Arrow batches small. (Executors that do not see that folder get the package from
    spark-submit's --py-files.)"""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(limit)) <= BATCH_ROWS:
        spark.conf.set(limit, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def saved(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written once to a fresh scratch table and read back with the same schema."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes scratch tables that no later step reads, and lets Spark's cleaner remove the shuffle
    files of finished jobs (it does so when the driver has collected the plans that own them)."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A driver-made table; callers pass at most one row per partition, vocabulary id or language."""
    return spark.createDataFrame(rows, schema)


def positions(df: DataFrame, keys: list[str | Column], name: str, **sums: str) -> DataFrame:
    """Adds ``pos`` (row number from 0 in the order of ``keys`` over all rows) and, for each
    ``alias=column`` of ``sums``, the sum of that column over all rows before.

    One range shuffle, written with its partition number; only one row of totals per partition
    reaches the driver. Keys should end in a near-unique column, else equal keys share a partition.
    """
    spark = df.sparkSession
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    keyed = df.select("*", *[c.alias(f"_k{i}") for i, c in enumerate(cols)])
    order = [f"_k{i}" for i in range(len(cols))]
    table = saved(keyed.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()), name)
    totals = sorted(tuple(r) for r in table.groupBy("_part").agg(
        F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in sums.values()]).collect())
    rows, before = [], [0] * (1 + len(sums))
    for part, *n in totals:
        rows.append((part, *before))
        before = [a + b for a, b in zip(before, n)]
    offsets = small(spark, rows, "_part int, _n long" + "".join(f", _o_{a} long" for a in sums))
    w = Window.partitionBy("_part").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    out = table.join(F.broadcast(offsets), "_part")  # at most one row per shuffle partition
    out = out.withColumn("pos", F.row_number().over(w) - 1 + F.col("_n"))
    for a, c in sums.items():
        out = out.withColumn(a, F.coalesce(F.sum(c).over(run), F.lit(0)) + F.col(f"_o_{a}"))
    return out.drop("_part", "_n", *order, *[f"_o_{a}" for a in sums])


def range_part(df: DataFrame, column: str, n: int) -> Column:
    """Partition number 0..n-1 of a numeric column by its quantiles over all rows (null: 0). The
    boundaries are plain literals, so that the rows need not be computed twice to be sampled."""
    bounds = sorted(set(df.approxQuantile(column, [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(column))), F.lit(0))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): every id of the links with the smallest id it reaches.

    Alternating large-star and small-star rounds: each round is two groupings of the links, the
    links only shrink towards the roots, and the number of rounds is logarithmic in the longest
    chain. A node's neighbours are never gathered: minima are aggregated and joined back, so a hub
    stays split.
    """
    spark = links.sparkSession
    def mark(e: DataFrame) -> tuple:
        """Count and checksum: the rounds end when a round leaves the links as they are."""
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                  .where("u is not null and v is not null and u <> v").distinct(), "links")
    state = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = (both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = saved(large, "large")
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        star = (large.join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                .union(low.select("x", "m")).where("u <> v").distinct())
        star = saved(star, "star")
        before, state = state, mark(star)
        dropped(spark, edges, large)
        edges = star
        if state == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v"), F.col("v")).distinct())


_HELD: list = [None, None]


def held(key: tuple, make):
    """What a Python worker keeps between tasks (a tokenizer, an automaton, a table): one thing at a
    time. Workers are reused by later stages, so whatever another operator left there is let go."""
    if _HELD[0] != key:
        _HELD[:] = None, None
        _HELD[:] = key, make()
    return _HELD[1]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
