"""Splitting, folds and resampling.

All randomness is a deterministic hash: ``md5('<seed>|<key>')``. The same seed gives the same
rows, and DuckDB can reproduce every assignment (D20: numpy's own draws are not reproducible
in Spark; sizes, ratios, disjointness and repeatability are kept).

Exact per-class ranks without a per-class global sort (``hash_rank``)
-----------------------------------------------------------------------
The first hex digits of the hash give a bucket. ``groupBy(class, bucket).count()`` is a
small table (<= 16**digits rows per class, independent of the data size); a running sum
over it gives each bucket its offset, and ``row_number`` only runs inside one
(class, bucket) — about N / 16**digits rows. Rank = offset + row number: identical to the
rank in a full sort by hash, but no task ever holds a whole class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_rank(df: DataFrame, key: str, seed: int = 42, by: list[str] | None = None,
              digits: int = 4, out: str = "hash_rank") -> DataFrame:
    """1-based rank of each row inside its ``by`` group in ascending ``md5(seed|key)`` order."""
    by = by or []
    h = hash_key(F.col(key), seed)
    d = df.withColumn("_h", h).withColumn("_bk", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int"))
    cnt = d.groupBy(*by, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    w = (Window.partitionBy(*by) if by else Window).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select(*by, "_bk", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    wi = Window.partitionBy(*by, "_bk").orderBy("_h", F.col(key))
    j = d.join(off, [*by, "_bk"], "inner")
    return j.withColumn(out, (F.col("_off") + F.row_number().over(wi)).cast("bigint")).drop("_h", "_bk", "_off")


def bucket_digits(n: int) -> int:
    """Hex digits of a bucket number such that a bucket holds about 100,000 rows, and a table of bucket
    counts at most 16**5 rows a class."""
    return min(5, max(2, math.ceil(math.log(max(1, n / 1e5), 16))))


def hash_first(df: DataFrame, key: str, seed: int, quotas: dict, target: str, out: str = "first") -> DataFrame:
    """Adds ``out``: whether the row is among the first ``quotas[class]`` of its class by hash.

    Bucket counts tell which bucket the last of them falls into: all other rows are decided by a
    projection, without a shuffle, and only the rows of that one bucket are ranked."""
    digits = bucket_digits(sum(quotas.values()))
    d = df.withColumn("_h", hash_key(F.col(key), seed)).withColumn("_bk", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int"))
    counts: dict = {}
    for c, b, n in d.groupBy(target, "_bk").count().collect():
        counts.setdefault(c, {})[b] = n
    before, at_edge, place = F.lit(False), F.lit(False), F.lit(None).cast("long")
    for c, q in quotas.items():
        left, edge = q, 16 ** digits
        for b in sorted(counts.get(c, {})):
            if counts[c][b] > left:
                edge = b
                break
            left -= counts[c][b]
        mine = F.col(target) == F.lit(c)
        before = before | (mine & (F.col("_bk") < edge))
        at_edge = at_edge | (mine & (F.col("_bk") == edge))
        place = F.when(mine, F.lit(left)).otherwise(place)
    at_edge = F.coalesce(at_edge, F.lit(False))
    w = Window.partitionBy(target).orderBy("_h", F.col(key))
    edge_rows = d.where(at_edge).withColumn(out, F.row_number().over(w) <= place)
    return d.where(~at_edge).withColumn(out, F.coalesce(before, F.lit(False))).unionByName(edge_rows).drop("_h", "_bk")


def class_counts(df: DataFrame, target: str) -> dict:
    """Class -> count (a small aggregate collected to the driver). Errors as the studied
    system: missing target values, fewer than two classes."""
    rows = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r[target]: r["n"] for r in rows}
    if None in counts:
        raise ValueError(f"Target column '{target}' contains missing values")
    if len(counts) < 2:
        raise ValueError("Stratified split requires at least 2 classes in the target")
    return counts


def test_quotas(counts: dict, test_size: float) -> dict:
    """n_test = ceil(N * test_size); per-class floor share + largest remainders (ties by class)."""
    n = sum(counts.values())
    n_test = math.ceil(n * test_size)
    base = {c: (n_test * k) // n for c, k in counts.items()}
    rem = sorted(counts, key=lambda c: (-((n_test * counts[c]) % n), c))
    left = n_test - sum(base.values())
    for c in rem[:left]:
        base[c] += 1
    return base


def stratified_split(df: DataFrame, target: str, key: str, test_size: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Exact per-class test allocation; adds ``split`` in {'train', 'test'}."""
    quotas = test_quotas(class_counts(df, target), test_size)
    r = hash_first(df, key, seed, quotas, target, "_first")
    return r.withColumn(out, F.when(F.col("_first"), "test").otherwise("train")).drop("_first")


def three_way_split(df: DataFrame, target: str, key: str, test_size: float = 0.2, val_size: float = 0.2,
                    seed: int = 42) -> DataFrame:
    """Test first, then validation out of the rest (val share of the whole)."""
    s1 = stratified_split(df, target, key, test_size, seed)
    rest = s1.filter(F.col("split") == "train").drop("split")
    s2 = stratified_split(rest, target, key, val_size / (1.0 - test_size), seed + 1)
    s2 = s2.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    return s1.filter(F.col("split") == "test").unionByName(s2)


def group_split(df: DataFrame, group: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """R2: whole groups to one side; ceil(test_size * G) groups in test, chosen by hash."""
    groups = df.select(group).distinct()
    g = groups.count()
    n_test = math.ceil(test_size * g)
    ranked = hash_rank(groups, group, seed)
    side = ranked.select(group, F.when(F.col("hash_rank") <= n_test, "test").otherwise("train").alias("split"))
    return df.join(side, group, "inner")


def split_report(df: DataFrame, target: str, split_col: str = "split") -> DataFrame:
    """Size and class distribution per split (and 'full'), with the drift of each class
    share from the full table in percentage points."""
    per = df.groupBy(split_col, target).agg(F.count(F.lit(1)).alias("n"))
    full = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).withColumn(split_col, F.lit("full"))
    a = per.unionByName(full)
    tot = a.groupBy(split_col).agg(F.sum("n").alias("size"))
    a = a.join(tot, split_col).withColumn("pct", F.col("n") * 100.0 / F.col("size"))
    f = a.filter(F.col(split_col) == "full").select(target, F.col("pct").alias("_fpct"))
    return a.join(f, target, "left").select(split_col, target, "n", "size", F.round("pct", 4).alias("pct"),
                                            F.round(F.abs(F.col("pct") - F.col("_fpct")), 4).alias("drift_pp"))


def undersample(df: DataFrame, target: str, key: str, ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """Keep every positive; keep n_pos / ratio negatives chosen by hash rank."""
    counts = class_counts(df, target)
    n_pos = counts.get(1, 0)
    n_keep = int(n_pos / ratio)
    neg = hash_first(df.filter(F.col(target) == 0), key, seed, {0: n_keep}, target, "_first").filter("_first").drop("_first")
    return df.filter(F.col(target) == 1).unionByName(neg)


def assign_folds(df: DataFrame, target: str, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Stratified k folds: per-class hash rank modulo k."""
    r = hash_rank(df, key, seed, [target])
    return r.withColumn(out, ((F.col("hash_rank") - 1) % k).cast("int")).drop("hash_rank")


def class_weights(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """R8: 'balanced' weights n / (k * n_c) joined to the rows (Spark broadcasts the class table by its size)."""
    c = df.groupBy(target).agg(F.count(F.lit(1)).alias("_nc"))
    tot = c.agg(F.sum("_nc"), F.count(F.lit(1))).first()
    n, k = tot[0], tot[1]
    w = c.select(target, (F.lit(float(n)) / (F.lit(float(k)) * F.col("_nc"))).alias(out))
    return df.join(w, target, "left")


def pos_weight(df: DataFrame, target: str) -> float:
    """Negatives / max(positives, 1) after resampling (a scalar for boosting)."""
    r = df.agg(F.sum(F.when(F.col(target) == 0, 1).otherwise(0)).alias("neg"),
               F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).alias("pos")).first()
    return float((r["neg"] or 0) / max(r["pos"] or 0, 1))
