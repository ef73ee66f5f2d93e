"""Operator 1: mixing sources to target weights by entropy balancing.

Targets: the mix shall hold ``share`` times all words; sources share it by weight, no target above
``cap`` times its source, the excess reshared by weight until none is above.

Rates: of all document rates r_i in [0, cap], take those of least relative entropy
sum r log r - r whose word totals meet the targets. The dual is convex in one multiplier per
source; its optimum tilts exponentially, r_i = min(cap, exp(lambda_s * size_i / mean_s)). Newton
steps on lambda (kept inside a bracket that every step narrows) run for all sources at once, as
aggregations over the table of (source, size) cells: all documents of a cell have the same rate, so
that table is exact and much smaller than the documents.

Copies: within a source, by ascending size, the running sum of rates is rounded, which fixes how
many copies each cell gives; single copies are then added or taken, the largest that fit first,
until a source's words are as near its target as its sizes allow. A cell's copies are dealt evenly
over its documents in hash order. Everything is a function of the data, so reruns agree.

Null source: a source of its own, last in order. Null or wordless text: size 0, no copies. Repeated
rows are documents of their own. Empty table: no rows. Extra columns are not read. Sources without
words get the target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscope.llm.common import WORD, dropped, fresh, positions, saved

#: The multiplier at which exp(lambda * size / mean) is over any cap for all sizes of one word and more.
STEEPEST = 1e6
NEWTON_STEPS = 60


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water-filling with one level theta,
    found by raising it until the set of capped sources no longer changes."""
    order = positions(sizes, [F.col("source").isNull(), "source"], "sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    table = order.select("source", "source_size", w.alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    total = float(share) * (table.agg(F.sum("source_size")).first()[0] or 0)
    theta = 0.0
    while True:
        full = F.col("w") * F.lit(theta) > F.col("most") if theta else F.col("most") <= 0
        held, weight = table.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("w")))).first()
        if not weight:
            return table.select("source", "source_size", F.col("most").alias("target"))
        new = (total - (held or 0.0)) / weight
        if new <= theta:
            return table.select("source", "source_size", F.least("most", F.col("w") * F.lit(theta)).alias("target"))
        theta = new


def rates(cells: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """(source, mean, lam): the dual optimum by safeguarded Newton steps over the cells."""
    spark = cells.sparkSession
    start = (cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
             .join(goals, F.expr("source <=> goal_source")).drop("goal_source"))
    state = start.select("source", "target", "source_size", F.greatest("mean", F.lit(1e-9)).alias("mean"), F.lit(0.0).alias("lam"),
                         F.lit(-STEEPEST).alias("lo"), F.lit(STEEPEST).alias("hi"), F.lit(False).alias("done"))
    state = saved(state, "newton")
    for _ in range(NEWTON_STEPS):
        z = F.col("size") / F.col("mean")
        r = F.least(F.lit(float(cap)), F.exp(F.least(F.lit(700.0), F.col("lam") * z)))
        free = F.col("lam") * z < F.log(F.lit(float(cap)))
        mass = F.col("n") * F.col("size") * r
        sums = (cells.join(state.select(F.col("source").alias("_s"), "mean", "lam").where("not done"), F.expr("source <=> _s"))
                .groupBy("source").agg(F.sum(mass).alias("got"), F.sum(F.when(free, mass * z).otherwise(0.0)).alias("slope"))
                .select(F.col("source").alias("_s"), "got", "slope"))
        j = state.join(sums, F.expr("source <=> _s"), "left").drop("_s")
        miss = F.col("got") - F.col("target")
        lo, hi = F.when(miss <= 0, F.col("lam")).otherwise(F.col("lo")), F.when(miss >= 0, F.col("lam")).otherwise(F.col("hi"))
        j = j.withColumn("lo2", F.coalesce(lo, "lo")).withColumn("hi2", F.coalesce(hi, "hi"))
        step = F.col("lam") - miss / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("lo2")) & (step < F.col("hi2"))
        # A target at a bound has its optimum at infinity; STEEPEST stands for it.
        at_cap = F.col("target") >= F.lit(float(cap)) * F.col("source_size")
        # Out of the bracket: its middle, on the scale of lambda once both ends are near.
        middle = F.when((F.col("hi2") - F.col("lo2")) > 8, F.greatest(F.col("lo2"), F.least(F.col("hi2"), F.when(miss < 0, F.col("lam") * 2 + 1).otherwise(F.col("lam") * 2 - 1)))
                        ).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        new = F.when(F.col("done") | F.col("got").isNull(), F.col("lam")).when(at_cap, F.lit(STEEPEST)).when(F.col("target") <= 0, F.lit(-STEEPEST)).when(inside, step).otherwise(middle)
        done = F.col("done") | F.col("got").isNull() | at_cap | (F.col("target") <= 0) | (F.abs(miss) <= F.lit(1e-9) * F.col("target"))
        new_state = saved(j.select("source", "target", "source_size", "mean", F.when(F.abs(miss) <= F.lit(1e-9) * F.col("target"), F.col("lam")).otherwise(new).alias("lam"),
                                   F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), done.alias("done")), "newton")
        dropped(spark, state)
        state = new_state
        if not state.where("not done").limit(1).count():
            break
    else:
        raise RuntimeError(f"a source's rate is not found after {NEWTON_STEPS} Newton steps")
    return state.select("source", "target", "source_size", "mean", "lam")


def quotas(cells: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """(source, size, n, copies, rate): whole copies of each cell, their words near the target."""
    spark = cells.sparkSession
    j = cells.join(state.withColumnRenamed("source", "_s"), F.expr("source <=> _s")).drop("_s")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.lit(700.0), F.col("lam") * F.col("size") / F.col("mean"))))
    j = j.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
    w = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("n") * F.col("rate")).over(w)  # a source has at most as many cells as distinct sizes
    j = j.withColumn("_c", upto)
    copies = F.floor(F.col("_c") + 0.5) - F.floor(F.greatest(F.lit(0.0), F.col("_c") - F.col("n") * F.col("rate")) + 0.5)
    j = j.withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(cap) * F.col("n"), copies)).cast("long"))
    table = saved(j.select("source", "size", "n", "target", "rate", "copies"), "quotas")
    while True:  # a step uses up a cell, or leaves less to move than the cell's size
        short = (table.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
                 .select(F.col("source").alias("_s"), "short"))
        j = table.join(short, F.expr("source <=> _s")).drop("_s")
        room = F.when(F.col("short") > 0, F.lit(cap) * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (room > 0) & (F.col("size") <= F.abs("short"))
        best = j.where(fits).groupBy(F.col("source").alias("_s")).agg(F.max("size").alias("_b"))
        best = saved(best, "fit")
        if not best.limit(1).count():
            dropped(spark, best)
            break
        move = F.least(room, F.floor(F.abs("short") / F.col("size")).cast("long")) * F.signum("short").cast("long")
        j = j.join(best, F.expr("source <=> _s"), "left")
        new = saved(j.select("source", "size", "n", "target", "rate", (F.col("copies") + F.when(F.col("size") == F.col("_b"), move).otherwise(0)).alias("copies")), "quotas")
        dropped(spark, table, best)
        table = new
    return table


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, doc_id: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (copies * size) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"))
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "source", "size"))
    placed = saved(positions(rows, [F.col("source").isNull(), "source", "size", "_h", "doc_id"], "mix-rows"), "mix-order")
    cells = saved(placed.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")), "cells")
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    goals = saved(targets(sizes, list(weights), share, cap), "targets")
    state = rates(cells.drop("first"), goals.withColumnRenamed("source", "goal_source"), cap)
    quota = quotas(cells.drop("first"), state, cap)
    plan = (quota.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "rate", F.col("copies").alias("k"))
            .join(cells.select(F.col("source").alias("_s2"), F.col("size").alias("_z2"), "first"), F.expr("_s <=> _s2 and _z = _z2"))
            .join(goals.withColumnRenamed("source", "_s3"), F.expr("_s <=> _s3"))
            .select("_s", "_z", "n", "rate", "k", "first", "source_size", "target"))
    out = placed.join(plan, F.expr("source <=> _s and size = _z"))
    # Whole numbers: the k copies of a cell fall evenly on its n documents, at most cap on each.
    copies = F.expr("CAST((CAST(pos - first + 1 AS DECIMAL(20,0)) * k) DIV n AS BIGINT) - CAST((CAST(pos - first AS DECIMAL(20,0)) * k) DIV n AS BIGINT)")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **law) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: left out, once, or repeated, with all their columns."""
    plan = mix(docs, doc_id=doc_id, text=text, source=source, **law)
    names = [fresh(docs, n) for n in ("_mix_key", "_mix_n", "_mix_top", "_mix_row", "_mix_copy")]
    mix_key, total, top, row, copy = names

    def key(i: Column, s: Column, z: Column) -> Column:
        return F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("null")), z.cast("string"), s.isNull().cast("string"), F.coalesce(s, F.lit("")))

    # Rows that repeat (doc_id, source, size) share one total, dealt by their order among each other.
    plan = (plan.where("copies > 0").groupBy(key(F.col("doc_id"), F.col("source"), F.col("size")).alias(mix_key))
            .agg(F.sum("copies").alias(total), F.max("copies").alias(top)))
    joined = docs.withColumn(mix_key, key(F.col(doc_id), F.col(source).cast("string"), words(F.col(text)))).join(plan, mix_key)
    # By a hash of the text: a task that runs again deals the copies to the same rows.
    joined = joined.withColumn(row, F.row_number().over(Window.partitionBy(mix_key).orderBy(F.xxhash64(F.col(text)))) - 1)
    take = F.greatest(F.lit(0), F.least(F.col(top), F.col(total) - F.col(row) * F.col(top))).cast("int")
    return (joined.withColumn(copy, take).where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
            .drop(*names))


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
