"""Operator 4: quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model is over characters (``ORDER``-grams of code points; runs of white space are one blank, and
a text starts after start marks) and has one part for each language. It is trained on every trusted text,
whole, each distinct text of a language once. One scan cuts the documents into chunks of about ``CHUNK``
characters, kept compressed; texts meet no join. Which texts count is joined by their numbers in the chunks, and
each chunk hands on its distinct n-grams with their counts in trusted texts. N-grams travel by shards of a
language: a row has all n-grams of a chunk that fall into a shard. Training is a
chain of counts and joins, sharded by n-gram: raw counts at the highest order, continuation counts
(distinct left neighbours) below; the three discounts of each order from its counts of counts; context
totals joined to the n-grams; and each order's probabilities joined to the next lower one's.

Scoring joins too: the corpus' distinct n-grams meet the tables order by order, backing off where an
n-gram was not seen, and the log probabilities return to the chunks, whose texts they are summed over. What
the chunks' texts take part in goes in ``WAVES``, each over its share of the chunks, so that only a share is in the shuffle at once. No
table is sent to the workers or the driver, so all of them may grow with the input. ``train`` and ``Model``
hold a small model in one process instead.

A document's perplexity is exp of the mean negative log probability of its characters. It is kept
unless its perplexity exceeds ``SLACK`` times the ``KEEP``-quantile of its language. The quantile is
that of the trusted documents the model is never trained on (a fourth, by the hash of the text, so
copies fall on one side); a language that has none takes all its trusted documents.

Null or blank text: perplexity null, not kept. A language without trusted text (null included): no
model, perplexity and threshold null, kept, as nothing speaks against it. Repeated rows are scored
alike; a trusted id that repeats counts as often. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscope.llm.common import dropped, held, partitions, saved, small

ORDER = 5
CHUNK = 4_000_000
KEEP = 0.99
SLACK = 1.2
PIECE = 250_000
WAVES = 4
TABLE = 1 << 24
START = "\0"

_U = np.uint64
#: Odd multipliers of the n-gram hash, one a position.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(ORDER + 2)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(32))) | _U(1)  # never 0, the mark of a free slot


def grams_of(points: np.ndarray, n: int) -> np.ndarray:
    """Sum of code point times factor for the n points that end at each position (from n - 1 on)."""
    acc = points[n - 1:] * FACTORS[0]
    for j in range(1, n):
        acc = acc + points[n - 1 - j:len(points) - j] * FACTORS[j]
    return acc


def tagged(acc: np.ndarray, n: int, lang: np.ndarray | int) -> np.ndarray:
    return mixed(acc + np.asarray([n], np.uint64) * FACTORS[ORDER] + np.asarray(lang).astype(np.uint64) * FACTORS[ORDER + 1])


class Table:
    """Open addressing: key -> float."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(np.ceil(np.log2(max(1, 2 * len(keys))))))
        self.mask = size - 1
        self.shift = _U(64 - int(np.log2(size)))
        self.keys = np.zeros(size, np.uint64)
        self.values = np.zeros(size, np.float32)
        slot, todo = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == 0
            put = todo[free]
            first = np.unique(slot[put], return_index=True)[1]
            put = put[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value)"""
        slot = (keys >> self.shift).astype(np.int64)
        here = self.keys[slot]
        found = here == keys
        value = np.where(found, self.values[slot], np.float32(0))
        todo = np.flatnonzero(~found & (here != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            here = self.keys[slot[todo]]
            hit = here == keys[todo]
            at = todo[hit]
            found[at], value[at] = True, self.values[slot[at]]
            todo = todo[~hit & (here != 0)]
        return found, value


_SPACE: list[np.ndarray] = []


def blanks() -> np.ndarray:
    if not _SPACE:
        _SPACE.append(np.array([chr(c).isspace() for c in range(0x3001)]))
    return _SPACE[0]


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each after ORDER - 1 start marks; text number of each point)."""
    gap = START * (ORDER - 1)
    joined = gap + gap.join(" ".join(t.split(START)) for t in texts)
    p = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    white = blanks()[np.minimum(p, 0x3000)]
    keep = np.ones(len(p), bool)
    keep[1:] = ~(white[1:] & white[:-1])
    p = np.where(white, 32, p)[keep].astype(np.uint64)
    return p, np.cumsum((p == 0) & (np.concatenate([[1], p[:-1]]) != 0)) - 1


class Model:
    def __init__(self, langs: list[str], keys: np.ndarray, logs: np.ndarray, contexts: np.ndarray, backs: np.ndarray, unseen: np.ndarray):
        self.number = {name: i for i, name in enumerate(langs)}
        self.p, self.back, self.unseen = Table(keys, logs), Table(contexts, backs), unseen

    def logs(self, points: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Log probability of the points from ORDER - 1 on, given the points before."""
        n = len(points) - ORDER + 1
        out, todo = np.zeros(n), np.flatnonzero(points[ORDER - 1:] != 0)
        lang = lang[ORDER - 1:]
        for order in range(ORDER, 0, -1):
            acc = grams_of(points, order)[ORDER - order:]
            found, value = self.p.get(tagged(acc[todo], order, lang[todo]))
            out[todo[found]] += value[found]
            todo = todo[~found]
            if order > 1:
                context = grams_of(points[:-1], order - 1)[ORDER - order:]
                out[todo] += self.back.get(tagged(context[todo], order - 1, lang[todo]))[1]
        out[todo] += self.unseen[lang[todo]]
        return out

    def score(self, texts: list[str | None], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, sum of log probabilities) of each text; 0 characters where there is no model."""
        count, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        known = [i for i, (t, name) in enumerate(zip(texts, langs)) if t and name in self.number]
        start = 0
        while start < len(known):
            end, size = start, 0
            while end < len(known) and (end == start or size + len(texts[known[end]]) <= PIECE):
                size += len(texts[known[end]])
                end += 1
            rows = np.array(known[start:end])
            points, of = points_of([texts[i] for i in rows])
            number = np.array([self.number[langs[i]] for i in rows])
            for at in range(0, max(1, len(points) - ORDER + 1), PIECE):
                part, who = points[at:at + PIECE + ORDER - 1], of[at:at + PIECE + ORDER - 1]
                logs = self.logs(part, number[who])
                real = part[ORDER - 1:] != 0
                total[rows] += np.bincount(who[ORDER - 1:][real], logs[real], len(rows))
                count[rows] += np.bincount(who[ORDER - 1:][real], minlength=len(rows))
            start = end
        return count, total


def held_out(text: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("held out"), F.col(text)), F.lit(4)) == 0


def chosen_texts(rows: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """(doc_id, lang, h, m) of one document of each distinct trusted text (hash h) that is not held out; m rows
    are alike in all three. Ids and hashes choose; texts do not leave the scan."""
    slim = rows.where("length(text) > 0 and lang is not null").where(~held_out("text")).select("doc_id", "lang", F.xxhash64("text").alias("h"))
    slim = slim.join(trusted_ids, F.col("doc_id") == F.col("_t"), "left_semi").groupBy("lang", "h", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    first = slim.groupBy("lang", "h").agg(F.min_by(F.struct("doc_id", "m"), "doc_id").alias("f"))
    return first.select(F.col("f.doc_id").alias("doc_id"), "lang", "h", F.col("f.m").alias("m"))


def ranks(x: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """(rank of each value among the distinct ones, their number) of values below size: through a table of marks,
    by sorting where that would be larger than TABLE."""
    if size > TABLE:
        found, rank = np.unique(x, return_inverse=True)
        return rank, len(found)
    seen = np.zeros(size, bool)
    seen[x] = True
    rank = np.cumsum(seen, dtype=np.int32)
    rank -= 1
    return rank[x], int(rank[-1]) + 1


class Grams:
    """The distinct n-grams of order ORDER of some texts of one language, by shard and in order within it, whatever
    the texts' order: ``of`` and ``at`` have the text and the n-gram of each character, ``shard`` and ``points``
    the shard and the code points of each n-gram."""

    def __init__(self, texts: list[str], shards: int):
        points, of = points_of(texts)
        real = np.flatnonzero(points[ORDER - 1:])
        code, size = ranks(points.astype(np.int32), 0x110000)
        at, n = code, size
        for i in range(1, ORDER):
            # Only what ends in a character counts at the highest order.
            at = at[:-1] * (np.int32 if n * size <= TABLE else np.int64)(size) + code[i:]
            at, n = ranks(at[real] if i == ORDER - 1 else at, n * size)
        first = np.empty(n, np.int64)
        first[at] = real
        grams = points[first[:, None] + np.arange(ORDER)]
        # By the first characters, so that a shard's n-grams are alike and pack well.
        shard = (mixed((grams[:, :ORDER - 2] * FACTORS[:ORDER - 2]).sum(1, dtype=np.uint64)) >> _U(8)) % _U(shards)
        order = np.argsort(shard, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.of, self.at = of[real + ORDER - 1], place[at]
        self.shard, self.points = shard[order].astype(np.int32), grams[order].astype("<u4")

    def pieces(self, counts: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(shard, number of its n-grams, the n-grams, their counts) of each shard that has n-grams."""
        cuts = [0, *(np.flatnonzero(np.diff(self.shard)) + 1), len(self.shard)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(self.shard[a]), int(b - a), packed(self.points[a:b]), packed(counts[a:b])


def packed(rows: np.ndarray) -> bytes:
    """The rows' first bytes, then their second ones and so on, compressed."""
    return pa.compress(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: pa.ChunkedArray, sizes: list[int], width: int) -> bytes:
    """The rows, of width bytes each, of all that ``packed`` gave for so many rows each."""
    parts = (pa.decompress(d, n * width, "zstd", asbytes=True) for d, n in zip(data.to_pylist(), sizes))
    return b"".join(np.frombuffer(d, np.uint8).reshape(width, -1).T.tobytes() for d in parts)


def split(joined: str) -> pa.Array:
    """The n-grams of order ORDER of a string of them."""
    data = np.frombuffer(joined.encode(), np.uint8)
    first = np.flatnonzero((data & 0xC0) != 0x80)[::ORDER]
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(data)).astype(np.int32)), pa.py_buffer(data))


def by_language(texts: list[str | None], langs: list[str | None], known: set[str]) -> Iterator[tuple[str, np.ndarray]]:
    """(language, numbers of its texts) of the texts that have a model and a character."""
    rows: dict[str, list[int]] = {}
    for i, (t, name) in enumerate(zip(texts, langs)):
        if t and name in known:
            rows.setdefault(name, []).append(i)
    for name in sorted(rows):
        yield name, np.array(rows[name], np.int64)


def sharded(spark: SparkSession) -> int:
    """The number of shards of the n-grams of a language."""
    return min(max(partitions(spark), 64), 512)


def chunked(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, lang, held, text, h) as chunks, dealt over WAVES: rows (wave, chunk, rows) with the first four
    columns, packed, of all rows of a chunk, and rows (wave, chunk, i, doc_id, lang, h) of its i-th row."""
    names = ["wave", "chunk", "rows", "i", "doc_id", "lang", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, size, n = [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(now).combine_chunks()
            sink = pa.BufferOutputStream()
            texts = table.drop_columns("h")
            with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as file:
                file.write_table(texts)

            def made(count: int, rows: pa.Array, i: pa.Array, *own: pa.Array) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([(part + n) % WAVES] * count, pa.int32()), pa.array([part << 32 | n] * count, pa.int64()),
                                                   rows, i, *own], names)

            own = [table[c] for c in ("doc_id", "lang", "h")]
            yield made(1, pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.nulls(1, pa.int32()), *(pa.nulls(1, c.type) for c in own))
            # What has no text or language has no part in the counts.
            some = np.flatnonzero(pc.and_(table["text"].is_valid(), table["lang"].is_valid()).to_numpy())
            yield made(len(some), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), *(c.take(some).combine_chunks() for c in own))

        for batch in batches:
            if batch.num_rows:
                now.append(batch)
                size += sum(len(t) for t in batch.column("text").to_pylist() if t)
                if size >= CHUNK:
                    yield from out()
                    now, size, n = [], 0, n + 1
        if now:
            yield from out()

    fields = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "lang", "held", "text", "h").mapInArrow(
        run, f"wave int, chunk long, rows binary, i int, doc_id {fields}, lang string, h long")


def pieces_of(texts: DataFrame, weights: DataFrame, langs: list[str]) -> DataFrame:
    """(chunk, lang, shard, n, g, c): the n n-grams g, packed, of a shard that a chunk (chunk, rows) has, and their counts c,
    summed over the chunk's rows by weight; rows (of, i, weight) have the weights other than 0."""
    known, shards = set(langs), sharded(texts.sparkSession)
    names = ["chunk", "lang", "shard", "n", "g", "c"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(chunk: pa.Table, given: pa.Table) -> pa.Table:
        held(("chunks",), list)  # lets go of what an earlier operator kept in this worker
        rows = pa.ipc.open_stream(chunk["rows"][0].as_buffer()).read_all()
        texts, weight, found = rows["text"].to_pylist(), np.zeros(rows.num_rows), []
        weight[given["i"].to_numpy()] = given["weight"].to_numpy()
        for name, own in by_language(texts, rows["lang"].to_pylist(), known):
            grams = Grams([texts[i] for i in own], shards)
            total = np.bincount(grams.at, weight[own[grams.of]], len(grams.shard))
            found += [(chunk["chunk"][0].as_py(), name, *piece) for piece in grams.pieces(total)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * len(types), types)], names)

    return texts.groupBy("chunk").cogroup(weights.groupBy("of")).applyInArrow(
        run, "chunk long, lang string, shard int, n int, g binary, c binary")


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) from the counts of counts 1 to 4."""
    n = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in range(1, 5)]
    t = counts.groupBy("lang").agg(*n)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    def d(i: int) -> Column:
        value = i - F.try_divide((i + 1) * y * F.col(f"n{i + 1}"), F.col(f"n{i}"))
        return F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0) & (value > 0), value).otherwise(F.lit(i * 0.5)).alias(f"d{i}")
    return t.select("lang", d(1), d(2), d(3))


def estimates(grams: DataFrame) -> tuple[list, list, dict]:
    """From the counts (lang, g, c) of the n-grams of order ORDER: tables (lang, g, v) of the log probabilities by
    order from 1 on, tables (lang, g, v) of the log back-off weights of contexts by length from 1 on, and the
    log probability of an unseen character by language."""
    counts = {ORDER: grams}
    for n in range(ORDER - 1, 0, -1):
        below = counts[n + 1].groupBy("lang", F.substring("g", 2, n).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        counts[n] = saved(below.where(F.substring("g", n, 1) != START), "counts")
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    lower, tables, backs, unseen = None, [], [], {}
    for n in range(1, ORDER + 1):
        # One row a language.
        j = counts[n].join(F.broadcast(discounts(counts[n])), "lang").select("lang", "g", "c", d.alias("d"), F.substring("g", 1, n - 1).alias("h"))
        totals = j.groupBy("lang", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("held"), F.count(F.lit(1)).alias("kinds"))
        totals = totals.select("lang", "h", "total", (F.col("held") / F.col("total")).alias("back"), "kinds")
        totals = saved(totals, "contexts")
        j = j.join(totals, ["lang", "h"])
        if n == 1:
            base = F.lit(1.0) / (F.col("kinds") + 1)
            unseen = {r.lang: float(np.log(max(r.back, 1e-9) / (r.kinds + 1))) for r in totals.collect()}
        else:
            j = j.join(lower.select("lang", F.col("g").alias("s"), F.col("p").alias("base")), (j["lang"] == lower["lang"]) & (F.substring(j["g"], 2, n - 1) == F.col("s"))).drop(lower["lang"])
            base = F.col("base")
            backs.append(totals.select("lang", F.col("h").alias("g"), F.log("back").alias("v")))
        lower = saved(j.select("lang", "g", ((F.col("c") - F.col("d")) / F.col("total") + F.col("back") * base).alias("p")), "probabilities")
        tables.append(lower.select("lang", "g", F.log("p").alias("v")))

    dropped(grams.sparkSession, *(counts[n] for n in range(1, ORDER)))
    return tables, backs, unseen


def train(trusted: DataFrame) -> tuple:
    """The arrays of a Model in memory, of all (lang, text) rows; for a small trusted table."""
    langs = sorted(r[0] for r in trusted.select("lang").distinct().collect())
    rows = trusted.select(F.lit(None).cast("long").alias("doc_id"), "lang", F.lit(False).alias("held"), "text", F.lit(0).cast("long").alias("h"))
    chunks = saved(chunked(rows), "chunks", "wave")
    weights = chunks.where("i is not null").select(F.col("chunk").alias("of"), "i", F.lit(1.0).alias("weight"))
    pieces = pieces_of(chunks.where("i is null").select("chunk", "rows"), weights, langs)
    tables, backs, unseen = estimates(saved(counted(pieces).where("c > 0").select("lang", "g", "c"), "counts"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: i for i, name in enumerate(langs)}
        for batch in batches:
            if batch.num_rows:
                g = batch.column("g").to_pylist()
                p = np.frombuffer("".join(g).encode("utf-32-le", "replace"), np.uint32).reshape(len(g), -1).astype(np.uint64)
                n = p.shape[1]
                acc = (p[:, ::-1] * FACTORS[:n]).sum(1, dtype=np.uint64)
                key = tagged(acc, n, np.array([number[x] for x in batch.column("lang").to_pylist()]))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("v")], ["k", "v"])

    def arrays(parts: list[DataFrame]) -> tuple[np.ndarray, np.ndarray]:
        got = [p.mapInArrow(keyed, "k long, v double").toArrow() for p in parts]
        one = pa.concat_tables(got)
        return one["k"].to_numpy().view(np.uint64), one["v"].to_numpy()

    keys, logs = arrays(tables)
    contexts, back = arrays(backs) if backs else (np.zeros(0, np.uint64), np.zeros(0))
    return langs, keys, logs.astype(np.float32), contexts, back.astype(np.float32), np.array([unseen[x] for x in langs])


def counted(pieces: DataFrame) -> DataFrame:
    """(lang, shard, g, c): the n-grams of all pieces with their whole counts in trusted texts, 0 included."""
    def run(pieces: pa.Table) -> pa.Table:
        n = pieces["n"].to_pylist()
        all_of = pa.table({"g": split(unpacked(pieces["g"], n, 4 * ORDER).decode("utf-32-le")), "c": np.frombuffer(unpacked(pieces["c"], n, 8))})
        t = all_of.group_by("g").aggregate([("c", "sum")])
        same = [pa.array([pieces[c][0].as_py()] * t.num_rows, pieces[c].type) for c in ("lang", "shard")]
        return pa.table([*same, t["g"], np.rint(t["c_sum"].to_numpy()).astype(np.int64)], ["lang", "shard", "g", "c"])

    return pieces.select("lang", "shard", "n", "g", "c").groupBy("lang", "shard").applyInArrow(run, "lang string, shard int, g string, c long")


def log_probabilities(grams: DataFrame, tables: list, backs: list, unseen: dict) -> DataFrame:
    """(lang, shard, g, v): the log probability of the last character of each of the n-grams (lang, shard, g)."""
    spark, seen = grams.sparkSession, {ORDER: grams.select("lang", "shard", "g")}
    for n in range(ORDER - 1, 0, -1):
        seen[n] = saved(seen[n + 1].select("lang", F.substring("g", 2, n).alias("g")).distinct(), "distinct")
    # One row a language.
    lower = F.broadcast(small(spark, list(unseen.items()), "lang string, v double")).withColumn("g", F.lit(""))
    for n in range(1, ORDER + 1):
        rows = seen[n].join(tables[n - 1].withColumnRenamed("v", "own"), ["lang", "g"], "left").withColumn("s", F.substring("g", 2, n - 1))
        back = F.lit(0.0)
        if n > 1:
            contexts = backs[n - 2].select("lang", F.col("g").alias("h"), F.col("v").alias("back"))
            rows, back = rows.withColumn("h", F.substring("g", 1, n - 1)).join(contexts, ["lang", "h"], "left"), F.coalesce("back", F.lit(0.0))
        rows = rows.join(lower.select("lang", F.col("g").alias("s"), F.col("v").alias("base")), ["lang", "s"])
        lower = saved(rows.select("lang", *["shard"] * (n == ORDER), "g", F.coalesce("own", back + F.col("base")).alias("v")), "values")
    dropped(spark, *(seen[n] for n in range(1, ORDER)))
    return lower


def answered(asked: DataFrame, values: DataFrame) -> DataFrame:
    """(of, lang, shard, n, v): the packed log probabilities of the n-grams of each piece (chunk, lang, shard, n, g), from
    rows (lang, shard, g, v) with the n-grams of a shard one after the other."""
    def run(pieces: pa.Table, known: pa.Table) -> pa.Table:
        n = pieces["n"].to_pylist()
        at = pc.index_in(split(unpacked(pieces["g"], n, 4 * ORDER).decode("utf-32-le")), value_set=split("".join(known["g"].to_pylist()))).to_numpy()
        found = known["v"].combine_chunks().flatten().to_numpy()[at]
        ends = np.cumsum(n, dtype=np.int64)
        own = [packed(found[a:b]) for a, b in zip([0, *ends], ends)]
        return pa.table([pieces["chunk"], pieces["lang"], pieces["shard"], pieces["n"], pa.array(own, pa.binary())], ["of", "lang", "shard", "n", "v"])

    return asked.groupBy("lang", "shard").cogroup(values.groupBy("lang", "shard")).applyInArrow(run, "of long, lang string, shard int, n int, v binary")


def perplexities(rows: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """doc_id, lang, held, n_scored (characters) and perplexity of every row (doc_id, lang, text)."""
    spark = rows.sparkSession
    chosen = saved(chosen_texts(rows, trusted_ids), "chosen")
    langs = sorted(r[0] for r in chosen.select("lang").distinct().collect())
    known, shards = set(langs), sharded(spark)
    # Texts are not joined with anything: a chunk's row numbers are.
    chunks = saved(chunked(rows.withColumns({"h": F.xxhash64("text"), "held": held_out("text")})), "chunks", "wave")
    weights = chunks.where("i is not null").join(chosen, ["doc_id", "lang", "h"])
    weights = saved(weights.select("wave", F.col("chunk").alias("of"), "i", (1.0 / F.col("m")).alias("weight")), "weights")
    texts = [chunks.where((F.col("wave") == wave) & F.col("i").isNull()).select("chunk", "rows") for wave in range(WAVES)]
    pieces = []
    for wave in range(WAVES):
        pieces.append(saved(pieces_of(texts[wave], weights.where(F.col("wave") == wave).drop("wave"), langs), "pieces"))
        dropped(spark)  # the shuffle files of this wave
    grams = saved(counted(reduce(DataFrame.unionAll, pieces)), "counts")
    dropped(spark, chosen, weights)
    tables, backs, unseen = estimates(grams.where("c > 0").select("lang", "g", "c"))
    values = log_probabilities(grams, tables, backs, unseen)
    values = values.groupBy("lang", "shard").agg(F.collect_list(F.struct("g", F.col("v").cast("float").alias("v"))).alias("l"))
    values = saved(values.select("lang", "shard", F.concat_ws("", "l.g").alias("g"), F.col("l.v").alias("v")), "answers")
    dropped(spark, grams)

    def summed(chunk: pa.Table, found: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(chunk["rows"][0].as_buffer()).read_all()
        texts = rows["text"].to_pylist()
        # The n-grams of a chunk's language are listed by shard.
        found = found.sort_by([("lang", "ascending"), ("shard", "ascending")])
        values, done = np.frombuffer(unpacked(found["v"], found["n"].to_pylist(), 4), np.float32), 0
        n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for name, own in by_language(texts, rows["lang"].to_pylist(), known):
            grams = Grams([texts[i] for i in own], shards)
            v = values[done:done + len(grams.shard)]
            done += len(v)
            total[own] = np.bincount(grams.of, v[grams.at], len(own))
            n[own] = np.bincount(grams.of, minlength=len(own))
        value = np.exp(-total / np.maximum(n, 1))
        return pa.table([rows["doc_id"], rows["lang"], rows["held"], pa.array(n), pa.array(value, mask=n == 0)],
                        ["doc_id", "lang", "held", "n_scored", "perplexity"])

    fields = rows.schema["doc_id"].dataType.simpleString()
    parts = []
    for wave in range(WAVES):
        found = answered(pieces[wave].select("chunk", "lang", "shard", "n", "g"), values)
        parts.append(saved(texts[wave].groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(
            summed, f"doc_id {fields}, lang string, held boolean, n_scored long, perplexity double"), "perplexities"))
        dropped(spark, pieces[wave])
    dropped(spark, chunks, values)
    return reduce(DataFrame.unionAll, parts)


def judged(docs: DataFrame, trusted_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, n_scored, perplexity, threshold and kept of every row. ``trusted_ids`` has the
    doc_id of the trusted documents."""
    t = trusted_ids.select(F.col("doc_id").alias("_t")).distinct()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    scored = perplexities(rows, t)
    limits = (scored.join(t, F.col("doc_id") == F.col("_t"), "left_semi").where("perplexity is not null").groupBy(F.col("lang").alias("_l"))
              .agg((F.coalesce(F.percentile_approx(F.when(F.col("held"), F.col("perplexity")), KEEP, 100_000),
                               F.percentile_approx("perplexity", KEEP, 100_000)) * SLACK).alias("threshold")))
    # One row for each language that has a model; those are few.
    limits = small(docs.sparkSession, [tuple(r) for r in limits.collect()], "_l string, threshold double")
    out = scored.join(F.broadcast(limits), F.col("lang") == F.col("_l"), "left").drop("_l")
    kept = F.when(F.col("perplexity").isNull(), F.col("threshold").isNull()).otherwise(F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select("doc_id", "lang", "n_scored", "perplexity", "threshold", kept.alias("kept"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, labels.where("quality = 1").select("doc_id"))
