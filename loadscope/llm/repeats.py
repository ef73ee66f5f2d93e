"""Operator 6: removal of long repeated byte strings with a logarithmic family of suffix arrays.

A byte goes when a ``WINDOW``-byte string that covers it also starts anywhere else in the corpus.
All suffixes of a corpus would take many times its size, so the arrays are sparse: every window has
a designated suffix inside it, the first of those whose ``HEAD``-byte head has the least hash.
Equal windows hold it at the same offset, so no repeat is missed, and about one suffix in 70 is
designated. Consecutive windows with the same suffix form a *run*.

1. Index family: documents come in batches (here: slices of the hash of the text). A batch's suffix
   heads are sorted into an array (by head hash), which is merge-scanned against every existing
   level for heads that both hold; heads repeated within the batch count as well. The array then
   becomes a level; two levels of equal rank merge into one of the next rank, and so on, so n
   batches leave at most log2(n) + 1 levels.
2. Runs with a shared head are candidates. Equal runs (hash of their whole bytes) are repeats as a
   whole. What is left is cut into slices of ``SLICE`` windows around the suffix; a slice whose
   common core nobody shares is settled, equal slices are repeats, and only the rest is decided
   window by window. One representative of each class of equal runs (slices) is kept to compare with.
3. The windows found make spans per distinct text; spans are cut out of the bytes.

Every step groups or joins hashes that are counted map-side first, so a passage that a third of all
documents share costs a counter and not a group. A text longer than ``PIECE`` bytes is hashed in
overlapping pieces. Texts are known by 96 bits of hash; of equal texts one is read.

Null text: empty bytes. Texts under ``WINDOW`` bytes lose nothing. Repeated rows are occurrences of
their own: they remove each other if long enough. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import dropped, saved

WINDOW = 200
HEAD = 64
SLICE = 16
PIECE = 1 << 20
BATCHES = 4

_U = np.uint64
_RNG = np.random.default_rng(8200)
BYTE_KEYS = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for b in (BASE, INVERSE):
            p = np.full(max(n, 1 << 20), b, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Hashed:
    """Hashes of any substring of a buffer, from prefix sums."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_KEYS[raw] * up[: len(raw)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray, salt) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + np.asarray(salt).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def runs(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, head hash, run hash, suffix, first window, last window) of all runs; positions in ``raw``.

    ``bounds`` are the ends of the pieces that make up ``raw``; no window crosses one."""
    n = len(raw)
    if n < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h = Hashed(raw)
    at = np.arange(n - HEAD + 1)
    value = h.of(at, at + HEAD, 0)
    place, best, width = at.astype(np.int32), value, 1
    count = WINDOW - HEAD + 1
    while width * 2 <= count:  # the first of the least values of each stretch of `width` heads
        right = best[width:] < best[:-width]
        place = np.where(right, place[width:], place[:-width])
        best = np.minimum(best[width:], best[:-width])
        width *= 2
    gap = count - width
    right = best[gap:] < best[: len(best) - gap]
    place = np.where(right, place[gap:], place[: len(place) - gap])  # one for each window start
    piece = np.repeat(np.arange(len(bounds)), np.diff(np.concatenate([[0], bounds])))
    start = np.arange(n - WINDOW + 1)
    start = start[piece[start] == piece[start + WINDOW - 1]]
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    suffix = place[start]
    new = np.flatnonzero(np.concatenate([[True], (suffix[1:] != suffix[:-1]) | (start[1:] != start[:-1] + 1)]))
    lo, hi, a = start[new], start[np.append(new[1:], len(start)) - 1], suffix[new].astype(np.int64)
    return piece[lo], value[a], h.of(lo, hi + WINDOW, (a - lo) * (WINDOW + 1) + hi - lo), a, lo, hi


def text_key(text: Column) -> list[Column]:
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("t1"), F.hash(body).alias("t2")]


def anchors(docs: DataFrame) -> DataFrame:
    """The sparse suffixes of all texts: t1, t2, head, run, a, lo, hi. A task gives a text's runs for its
    first two copies only: two occurrences prove the repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        names = ["t1", "t2", "head", "run", "a", "lo", "hi"]

        def flush(held: list) -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
            ends = np.cumsum([len(h[3]) for h in held])
            piece, head, whole, a, lo, hi = runs(raw, ends)
            shift = np.array([h[2] for h in held], np.int64) - np.concatenate([[0], ends[:-1]])
            move = shift[piece]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array([h[0] for h in held], np.int64)[piece]), pa.array(np.array([h[1] for h in held], np.int32)[piece]),
                 signed(head), signed(whole), pa.array(a + move), pa.array(lo + move), pa.array(hi + move)], names)

        held, size = [], 0
        for batch in batches:
            for t1, t2, raw in zip(*(batch.column(c) for c in ("t1", "t2", "raw"))):
                key = t1.as_py(), t2.as_py()
                seen[key] = seen.get(key, 0) + 1
                if seen[key] > 2:
                    continue
                data = raw.as_py()
                for at in range(0, max(1, len(data) - WINDOW + 1), PIECE):
                    held.append((*key, at, data[at:at + PIECE + WINDOW - 1]))
                    size += len(held[-1][3])
                    if size >= PIECE:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return (docs.select("t1", "t2", F.col("text").cast("binary").alias("raw")).where(F.length("raw") >= WINDOW)
            .mapInArrow(run, "t1 long, t2 int, head long, run long, a long, lo long, hi long"))


class IndexFamily:
    """Levels of sorted suffix heads; ``add`` scans a batch against them and files it."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}

    def add(self, heads: DataFrame) -> DataFrame:
        """Heads of the batch (column ``head``, one row a suffix) -> those that occur elsewhere too."""
        spark = heads.sparkSession
        array = saved(heads.groupBy("head").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("head"), "suffixes")
        found = array.where("n > 1").select("head")
        for level in self.levels.values():
            found = found.union(array.join(level, "head", "left_semi").select("head"))
        found = saved(found.distinct(), "shared-heads")
        rank = 0
        while rank in self.levels:
            other = self.levels.pop(rank)
            merged = saved(array.union(other).groupBy("head").agg(F.sum("n").alias("n")).sortWithinPartitions("head"), "suffixes")
            dropped(spark, array, other)
            array, rank = merged, rank + 1
        self.levels[rank] = array
        return found

    def drop(self, spark) -> None:
        dropped(spark, *self.levels.values())


def contexts(docs: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted runs (t1, t2, a, lo, hi, known): one copy of each text is read."""
    listed = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "lo", "hi", "known")).alias("r"))
    listed = listed.join(texts.select("t1", "t2", "first"), ["t1", "t2"]).withColumnsRenamed({"t1": "_1", "t2": "_2"})
    held = docs.join(listed, F.expr("t1 = _1 and t2 = _2 and doc_id <=> first")).dropDuplicates(["t1", "t2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, rows = batch.column("raw")[i].as_py(), batch.column("r")[i].as_py()
                rows.sort(key=lambda r: r["lo"])
                for at in range(0, len(rows), 4096):
                    part = rows[at:at + 4096]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("t1")[i].as_py()] * n, pa.int64()), pa.array([batch.column("t2")[i].as_py()] * n, pa.int32()),
                         *(pa.array([r[c] for r in part], pa.int64()) for c in ("a", "lo", "hi", "known")),
                         pa.array([raw[r["lo"]:r["hi"] + WINDOW] for r in part], pa.binary())],
                        ["t1", "t2", "a", "lo", "hi", "known", "bytes"])

    return held.select("t1", "t2", "r", F.col("text").cast("binary").alias("raw")).mapInArrow(
        run, "t1 long, t2 int, a long, lo long, hi long, known long, bytes binary")


def stacked(batch: pa.RecordBatch) -> tuple[Hashed, np.ndarray]:
    """The bytes of all rows, hashed, and what turns a row's positions into those of the stack."""
    parts = batch.column("bytes").to_pylist()
    sizes = np.array([len(p) for p in parts])
    return Hashed(np.frombuffer(b"".join(parts), np.uint8)), np.cumsum(sizes) - sizes - batch.column("lo").to_numpy()


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every value of first..last of each row."""
    n = last - first + 1
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """core, part (hash of the slice's bytes), t1, t2, lo (of the run), i, j (first, last window), known."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            b = whole.slice(at, 2048)
            h, move = stacked(b)
            a, lo, hi, known = (b.column(c).to_numpy() for c in ("a", "lo", "hi", "known"))
            row, s = spread((a - hi) // SLICE, (a - lo) // SLICE)
            i, j = np.maximum(lo[row], a[row] - SLICE * s - SLICE + 1), np.minimum(hi[row], a[row] - SLICE * s)
            c = a[row] - SLICE * s + move[row]
            core = h.of(c, c + WINDOW - SLICE + 1, s + 1)
            part = h.of(i + move[row], j + move[row] + WINDOW, (a[row] - i) * (WINDOW + 1) + j - i)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [signed(core), signed(part), b.column("t1").take(take), b.column("t2").take(take), pa.array(lo[row]), pa.array(i), pa.array(j),
                 pa.array(known[row])], ["core", "part", "t1", "t2", "lo", "i", "j", "known"])


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """core, part (hash of the window's bytes), t1, t2, i, known, for every window of the listed slices."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            b = whole.slice(at, 512)
            h, move = stacked(b)
            lists = b.column("s").to_pylist()
            of = np.repeat(np.arange(b.num_rows), [len(x) for x in lists])
            core, i, j, known = (np.array([r[c] for x in lists for r in x], np.int64) for c in ("core", "i", "j", "known"))
            row, at_i = spread(i, j)
            p = at_i + move[of[row]]
            take = pa.array(of[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(core[row]), signed(h.of(p, p + WINDOW, 0)), b.column("t1").take(take), b.column("t2").take(take), pa.array(at_i),
                 pa.array(known[row])], ["core", "part", "t1", "t2", "i", "known"])


def repeated_spans(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(t1, t2, spans): arrays of (first, end) of repeated bytes of each distinct text that has some.

    ``docs``: doc_id, text, t1, t2 of all rows; ``texts``: t1, t2, first (a doc_id) of all distinct texts."""
    spark = docs.sparkSession
    every = saved(anchors(docs).withColumn("batch", F.pmod("t1", F.lit(BATCHES)).cast("int")), "anchors", "batch")
    family, found = IndexFamily(), []
    for b in range(BATCHES):
        found.append(family.add(every.where(F.col("batch") == b).select("head")))
    heads = found[0]
    for f in found[1:]:
        heads = heads.union(f)
    # A head that repeats within a later batch or between two may be found more than once.
    candidate = saved(every.join(heads.distinct(), "head", "left_semi").drop("batch"), "candidates")
    dropped(spark, every, *found)
    family.drop(spark)
    groups = saved(candidate.groupBy("head", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "a", "lo", "hi")).alias("one"))
                   .where("n > 1"), "equal-runs")
    whole = candidate.join(groups.select("head", "run"), ["head", "run"], "left_semi").select("t1", "t2", "lo", F.col("hi").alias("last")).distinct()
    whole = saved(whole, "whole-runs")
    rest = saved(candidate.join(groups.select("head", "run"), ["head", "run"], "left_anti"), "open-runs")
    known = groups.join(rest.select("head").distinct(), "head", "left_semi").select("one.*").withColumn("known", F.lit(1).cast("long"))
    wanted = saved(rest.select("t1", "t2", "a", "lo", "hi").withColumn("known", F.lit(0).cast("long")).union(known), "wanted")
    dropped(spark, candidate, groups, rest)
    context = saved(contexts(docs, texts, wanted), "contexts")
    dropped(spark, wanted)
    parts = saved(context.mapInArrow(sliced, "core long, part long, t1 long, t2 int, lo long, i long, j long, known long"), "slices")
    dropped(spark)
    cores = parts.groupBy("core").agg(F.sum(F.col("known") + 1).alias("n"), F.min("known").alias("k")).where("n > 1 and k = 0").select("core")
    parts2 = saved(parts.join(cores, "core", "left_semi"), "shared-slices")
    dropped(spark, parts)
    equal = saved(parts2.groupBy("core", "part").agg(F.sum(F.col("known") + 1).alias("n"), F.min(F.struct("t1", "t2", "lo", "i", "j")).alias("one"))
                  .where("n > 1"), "equal-slices")
    part_of = parts2.join(equal.select("core", "part"), ["core", "part"], "left_semi").where("known = 0").select("t1", "t2", F.col("i").alias("lo"), F.col("j").alias("last"))
    part_of = saved(part_of, "whole-slices")
    rest = saved(parts2.join(equal.select("core", "part"), ["core", "part"], "left_anti").where("known = 0"), "open-slices")
    known = equal.join(rest.select("core").distinct(), "core", "left_semi").select("core", "one.*", F.lit(1).cast("long").alias("known"))
    listed = rest.select("core", "t1", "t2", "lo", "i", "j", "known").union(known)
    listed = listed.groupBy("t1", "t2", "lo").agg(F.collect_list(F.struct("core", "i", "j", "known")).alias("s"))
    # A run appears once as open or once as representative; either has the same bytes.
    single = saved(context.dropDuplicates(["t1", "t2", "lo"]).join(listed, ["t1", "t2", "lo"]).select("t1", "t2", "lo", "bytes", "s")
                   .mapInArrow(windows, "core long, part long, t1 long, t2 int, i long, known long"), "windows")
    dropped(spark, parts2, equal, rest, context)
    twice = single.groupBy("core", "part").agg(F.sum(F.col("known") + 1).alias("n"), F.min("known").alias("k")).where("n > 1 and k = 0").select("core", "part")
    ones = saved(single.where("known = 0").join(twice, ["core", "part"], "left_semi").select("t1", "t2", F.col("i").alias("lo"), F.col("i").alias("last")), "single-windows")
    dropped(spark, single)
    return whole.union(part_of).union(ones).groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "last")).alias("spans"))


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Maximal removed runs (first, end) of windows (first, last start)."""
    if not spans:
        return []
    a = np.array([(s["lo"], s["last"] + WINDOW) for s in spans], np.int64)
    a = a[np.argsort(a[:, 0], kind="stable")]
    reach = np.maximum.accumulate(a[:, 1])
    new = np.flatnonzero(np.concatenate([[True], a[1:, 0] > reach[:-1]]))
    return list(zip(a[new, 0].tolist(), reach[np.append(new[1:], len(a)) - 1].tolist()))


def stripped_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows are doc_id, t1, t2; texts have, once for each distinct text, t1, t2, n_bytes,
    n_removed, n_spans and kept (the remaining bytes)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *text_key(F.col(text)))
    slim = saved(rows.select("doc_id", "t1", "t2"), "rows")
    texts = saved(slim.groupBy("t1", "t2").agg(F.min("doc_id").alias("first")), "texts")
    spans = saved(repeated_spans(rows, texts), "spans")
    dropped(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
                for raw, s in zip(b.column("raw"), b.column("spans")):
                    data, cut, parts, end = raw.as_py(), merged(s.as_py()), [], 0
                    for first, last in cut:
                        parts.append(data[end:first])
                        end = last
                    kept = b"".join([*parts, data[end:]])
                    for k, v in zip(out, (len(data), len(data) - len(kept), len(cut), kept)):
                        out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("t1"), b.column("t2"), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], ["t1", "t2", *out])

    found = texts.join(spans, ["t1", "t2"], "left").withColumnsRenamed({"t1": "_1", "t2": "_2"})
    held = rows.join(found, F.expr("t1 = _1 and t2 = _2 and doc_id <=> first")).select("t1", "t2", F.col("text").cast("binary").alias("raw"), "spans")
    made = held.dropDuplicates(["t1", "t2"]).mapInArrow(run, "t1 long, t2 int, n_bytes long, n_removed long, n_spans long, kept binary")
    return slim, made


def digest(docs: DataFrame) -> DataFrame:
    rows, texts = stripped_texts(docs)
    found = saved(texts.select("t1", "t2", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "stripped")
    dropped(docs.sparkSession)
    return rows.join(found, ["t1", "t2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
