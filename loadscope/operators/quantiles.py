"""Exact quantiles of many columns by radix selection.

A double maps to a 64-bit integer that sorts as it does. The first pass counts all columns' values by the
top bits of that integer; the count tells which prefix holds each wanted rank, and the next pass
counts only the values under those prefixes, by the next bits. After at most ``len(ROUNDS)`` passes all
bits are known; a prefix whose least and greatest value are the same is known at once, and when the prefixes hold
at most ``FEW`` values, the next pass counts those by all of their bits. Tasks count
their rows in numpy and hand on (column, prefix, count, least, greatest), so nothing is sorted by
value, no task holds distinct values and equal values cost nothing. The counts under a prefix asked for (2^13, or
``FEW``, times the parts) meet in one task, which finds the ranks there: a row for each rank reaches the driver,
whatever the data. The columns are projected and written once.

Quantiles interpolate linearly between the two neighbouring ranks. ``complement_quantiles`` finds those
of the rows outside of each part of a table (the training rows of each fold) in the same passes: counts
are kept by part, and a complement's are the total's less the part's.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.session import delete_path, importable, scratch_path

#: Bits that each pass adds to the known prefixes.
ROUNDS = (13, 13, 13, 13, 12)
LOW = np.int64(0x7FFFFFFFFFFFFFFF)
#: Values under the wanted prefixes that a pass may tell apart at once: as many rows at most.
FEW = 1 << 16
#: Values that a task counts at a time: a batch may be a few hundred rows, and its counts as many as it has values.
HELD = 1 << 21


def sort_key(x: np.ndarray) -> np.ndarray:
    """Integers that sort as the doubles do; both zeros are one value."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & LOW)


def value_of(key: int) -> float:
    k = np.array([key], np.int64)
    return float((k ^ ((k >> 63) & LOW)).view(np.float64)[0])


def _counted(opened: dict[str, list[int]], done: int, bits: int):
    """Of every ``HELD`` values or so of a task: (column, prefix of done + bits bits, part, count, least and greatest key)
    under the opened prefixes."""
    def counted(part: np.ndarray, values: dict[str, np.ndarray]) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for number, (c, prefixes) in enumerate(opened.items()):
            wanted = np.sort(np.array(prefixes, np.int64))
            for p in np.unique(part).tolist():
                key = sort_key(values[c][~np.isnan(values[c]) & (part == p)])
                if done:
                    top = key >> (64 - done)
                    key = key[wanted.take(np.searchsorted(wanted, top), mode="clip") == top]
                if not len(key):
                    continue
                key.sort()
                prefix = key >> (64 - done - bits)
                first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
                last = np.concatenate([first[1:], [len(key)]])
                for column, found in zip(out, (np.full(len(first), number), prefix[first], np.full(len(first), p), last - first, key[first], key[last - 1])):
                    column.append(found)
        number, *rest = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        names, types = pa.array(list(opened), pa.string()), [pa.int64(), pa.int32(), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([names.take(pa.array(number, pa.int64())), *[pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(rest, types)]],
                                          ["c", "prefix", "part", "n", "least", "greatest"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size = [], 0

        def out() -> pa.RecordBatch:
            column = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in now])
            return counted(column("part"), {c: column(c).astype(np.float64) for c in opened})

        for batch in batches:
            now.append(batch)
            size += batch.num_rows * len(opened)
            if size >= HELD:
                yield out()
                now, size = [], 0
        if size:
            yield out()
    return count


_RANKS = "c string, of int, rank long, prefix long, under long, n long, least long, greatest long, total long"


def _located(asked: dict[tuple[str, int], list[tuple[int, int, int]]], without: list, probs: list[float]) -> Callable:
    """Of all counts of a column under one opened prefix: (set, rank, longer prefix that holds it, rank under that, its
    count, least and greatest key, all values counted). ``asked`` has (set, rank, rank under the prefix) by column and
    prefix; nothing asked is the first pass, whose total tells the ranks of ``probs``."""
    def located(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        c, top = (k.as_py() for k in key)
        of_part, n, prefix, least, greatest = (table.column(i).to_numpy() for i in ("part", "n", "prefix", "least", "greatest"))
        out = []
        for number, v in enumerate(without):
            here = np.flatnonzero(of_part != v) if v is not None else np.arange(len(n))
            here = here[np.argsort(prefix[here], kind="stable")]
            if not len(here):
                continue
            first = np.flatnonzero(np.concatenate([[True], prefix[here][1:] != prefix[here][:-1]]))
            counts = np.add.reduceat(n[here], first)
            upto = np.cumsum(counts)
            total = int(upto[-1])
            at = {k for p in probs for k in (math.floor(p * (total - 1)), math.ceil(p * (total - 1)))}
            ranks = [(rank, k) for s, rank, k in asked[c, top] if s == number] if asked else [(k, k) for k in sorted(at)]
            lows, highs = np.minimum.reduceat(least[here], first), np.maximum.reduceat(greatest[here], first)
            for rank, k in ranks:
                i = int(np.searchsorted(upto, k, "right"))
                out.append((c, number, rank, int(prefix[here[first[i]]]), k - int(upto[i] - counts[i]), int(counts[i]), int(lows[i]), int(highs[i]), total))
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names=[f.split()[0] for f in _RANKS.split(", ")])
    return located


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Column -> its quantiles (None without values); NULL and NaN are left out."""
    return _quantiles(df, cols, probs, F.lit(0), [None])[None]


def complement_quantiles(df: DataFrame, cols: list[str], probs: list[float], part: str, parts: list[int]) -> dict[int, dict[str, list[float | None]]]:
    """Part -> column -> quantiles of the rows outside of the part (``part`` is an integer column)."""
    return _quantiles(df, cols, probs, F.col(part), parts)


def _quantiles(df: DataFrame, cols: list[str], probs: list[float], part: Column, without: list) -> dict:
    spark = importable(df.sparkSession)
    path = scratch_path(spark, "quantiles")
    names = [f"c{i}" for i in range(len(cols))]
    df.select(part.cast("int").alias("part"), *[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)]).write.parquet(path)
    rows = spark.read.schema("part int, " + ", ".join(f"{n} double" for n in names)).parquet(path)
    sets = [(v, n) for v in without for n in names]
    total = dict.fromkeys(sets, 0)
    found: dict[tuple, float] = {}  # (set, rank) -> value
    asked: dict[tuple, dict[int, int]] = {(s, 0): {} for s in sets}  # (set, prefix) -> rank -> rank under the prefix
    done, few = 0, False
    for bits in ROUNDS:
        bits = 64 - done if few else bits
        opened: dict[str, list[int]] = defaultdict(list)
        for (_, n), prefix in asked:
            opened[n].append(prefix)
        counts = rows.select("part", *opened).mapInArrow(_counted(dict(opened), done, bits), "c string, prefix long, part int, n long, least long, greatest long")
        # Top bits are few: their counts are added up where the ranks are looked for. Others are added up before.
        counts = (counts if done else counts.repartition("c")).groupBy("c", "prefix", "part").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
        wanted: dict[tuple[str, int], list[tuple[int, int, int]]] = defaultdict(list)
        for ((v, n), prefix), ranks in asked.items():
            wanted[n, prefix] += [(without.index(v), rank, k) for rank, k in ranks.items()]
        top = F.shiftright("prefix", bits) if done else F.lit(0).cast("long")
        # A row for each rank of each set.
        places = counts.groupBy("c", top.alias("top")).applyInArrow(_located(dict(wanted) if done else {}, without, probs), _RANKS).collect()
        following: dict[tuple, dict[int, int]] = defaultdict(dict)
        left = {}  # (set, longer prefix) -> its values
        for r in places:
            s = (without[r.of], r.c)
            if not done:
                total[s] = r.total
            if r.least == r.greatest:
                found[s, r.rank] = value_of(r.least)
            else:
                following[s, r.prefix][r.rank] = r.under
                left[s, r.prefix] = r.n
        asked, done, few = following, done + bits, sum(left.values()) <= FEW
        if not asked:
            break
    delete_path(spark, path)

    def quantile(s: tuple, p: float) -> float | None:
        if not total[s]:
            return None
        at = p * (total[s] - 1)
        lo, hi = math.floor(at), math.ceil(at)
        return found[s, lo] if lo == hi else (hi - at) * found[s, lo] + (at - lo) * found[s, hi]

    return {v: {c: [quantile((v, n), p) for p in probs] for c, n in zip(cols, names)} for v in without}
