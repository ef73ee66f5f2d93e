"""Operator 12: resampling towards a target distribution, with a head-tail vocabulary.

A document's features are its runs of 1 to ``n_max`` words (one or two), each hashed to a bucket by
CRC-32 of its bytes. The head is broadcast: the CRC states of at most ``HEAD`` frequent words of at
most ``WORD_BYTES`` bytes, so that a pair goes on from its first word's state, and the buckets of at
most ``HEAD`` frequent pairs. Any other feature takes its CRC directly. Head and tail give the same
numbers, so the head decides speed and never a result. A word is frequent if the tasks in whose share
it is frequent hold 1/HEAD of all words in it; the long tail is neither kept nor shuffled.

Bucket totals of corpus and target are exact sums of per-task vectors; a bucket's gain is the
logarithm of its share in the target over its share in the corpus, with one added to each bucket; a
document's weight is its features' mean gain, and its score adds Gumbel noise drawn from a hash of
its id, so that the highest scores are a sample without replacement by weight that every rerun
repeats. The draw ranks eligible rows by (score descending, id) with a range shuffle.

Null or wordless text: no features, weight 0. Null id: its noise comes from an empty id, and it
sorts before others. Repeated rows are rows of their own; of rows that tie in score and id any may
take the rank. No eligible row, empty table on either side: nothing is drawn, all sums are 0. Texts
are read in pieces, so a very long one is never a list of its words. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import positions, saved
from loadscope.llm.plain_words import word_lists

HEAD = 4096
WORD_BYTES = 256
#: Distinct features that a task counts before it hands on the frequent ones.
COUNTED = 1 << 17


class States(dict):
    """CRC states by word: the head's are held, any other word's is computed."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class PairBuckets(dict):
    """Buckets by pair of words: the head's are held, any other pair goes on from its first word's state."""

    def __init__(self, states: States, buckets: int, held: list[tuple[bytes, bytes]] = ()):
        self.states, self.buckets = states, buckets
        super().__init__((p, self[p]) for p in held)

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return zlib.crc32(b" " + pair[1], self.states[pair[0]]) % self.buckets

    def __reduce__(self):
        return PairBuckets, (self.states, self.buckets, list(self))


class Vocabulary:
    """What is broadcast: at most ``HEAD`` words and ``HEAD`` pairs."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], n_max: int, buckets: int):
        self.states = States((w, zlib.crc32(w)) for w in words)
        self.pairs = PairBuckets(self.states, buckets, pairs)
        self.n_max, self.buckets = n_max, buckets

    def pieces(self, text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
        """Words and buckets of all features of a text, piece by piece."""
        last: list[bytes] = []
        for words in word_lists(text):
            state = np.fromiter(map(self.states.__getitem__, words), np.int64, len(words))
            found = state % self.buckets
            if self.n_max == 2:
                run = last + words
                pairs = np.fromiter(map(self.pairs.__getitem__, zip(run, run[1:])), np.int64, max(0, len(run) - 1))
                found, last = np.concatenate([found, pairs]), run[-1:]
            yield len(words), found


def _frequent(head: frozenset | None):
    """Counts of the words (of the pairs of ``head`` words, if given) that are frequent in a task's share."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told() -> pa.RecordBatch:
            total = sum(seen.values())
            kept = [((b"", b""), total)] + [(f if head else (f, None), n) for f, n in seen.items() if n * HEAD >= total]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f, _ in kept], pa.binary()), pa.array([f[1] for f, _ in kept], pa.binary()),
                                               pa.array([n for _, n in kept], pa.int64())], ["a", "b", "n"])

        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                for words in word_lists(text):
                    if head:
                        seen.update(p for p in zip(words, words[1:]) if p[0] in head and p[1] in head)
                    else:
                        seen.update(words)
                    if len(seen) >= COUNTED:
                        yield told()
        yield told()
    return counts


def vocabulary(texts: DataFrame, n_max: int, buckets: int) -> Vocabulary:
    """The head of a table of texts. A frequent pair consists of frequent words, so pairs of others are not counted."""
    def top(head: frozenset | None) -> list:
        found = saved(texts.mapInArrow(_frequent(head), "a binary, b binary, n long").where(f"octet_length(a) <= {WORD_BYTES}")
                      .groupBy("a", "b").agg(F.sum("n").alias("n")), "frequent")
        # The empty word carries the number of all; at most HEAD others can hold a share of 1/HEAD of it.
        total = found.where("octet_length(a) = 0").first()
        best = found.where(f"octet_length(a) > 0 and n * {HEAD} >= {total.n}").collect() if total else []
        return [(bytes(r.a), r.b and bytes(r.b)) for r in best]

    words = [a for a, _ in top(None)]
    return Vocabulary(words, top(frozenset(words)) if n_max == 2 and words else [], n_max, buckets)


def bucket_totals(texts: DataFrame, shared) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        total = np.zeros(v.buckets, np.int64)
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                for _, found in v.pieces(text):
                    total += np.bincount(found, minlength=v.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(shared.value.buckets, np.int64)
    for r in texts.mapInArrow(counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    k = len(corpus)
    s_all, t_all = float(corpus.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weighed(shared, gain: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            words, features, weight = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                n = m = total = 0
                for count, found in v.pieces(text):
                    n, m, total = n + count, m + len(found), total + int(gain[found].sum())
                words.append(n)
                features.append(m)
                weight.append(total // m if m else 0)
            held = [(c, batch.column(c)) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([x for _, x in held] + [pa.array(x, pa.int64()) for x in (words, features, weight)],
                                             [c for c, _ in held] + ["n_words", "n_features", "weight"])
    return weigh


def _ranked(rows: DataFrame, target: DataFrame, n_max: int, buckets: int, seed: int, percent: int, least_words: int) -> DataFrame:
    """``rows`` (doc_id, text and what else is to be kept) without the text, with n_words, n_features, weight, score and rank."""
    if n_max not in (1, 2):
        raise ValueError("features are runs of one or two words at most")
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(rows.select("text"), n_max, buckets))
    gain = gains(bucket_totals(rows.select("text"), shared), bucket_totals(target, shared))
    kept = rows.drop("text")
    schema = kept.schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = saved(rows.mapInArrow(_weighed(shared, gain), schema).withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    eligible = F.col("n_words") >= least_words
    drawn = percent * scored.where(eligible).count() // 100
    placed = positions(scored.where(eligible), [-F.col("score"), "doc_id", "n_features", "weight"], "ranked")
    ranked = placed.withColumn("rank", F.when(F.col("pos") < drawn, F.col("pos") + 1).cast("long")).drop("pos")
    return ranked.unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")))


def importance(docs: DataFrame, target: DataFrame, n_max: int = 2, buckets: int = 10_000, seed: int = 0, percent: int = 10,
               least_words: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _ranked(rows, target.select(F.col(text).alias("text")), n_max, buckets, seed, percent, least_words)


def resampled(docs: DataFrame, target: DataFrame, n_max: int = 2, buckets: int = 10_000, seed: int = 0, percent: int = 10,
              least_words: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn rows of ``docs`` with all their columns."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*docs.columns).alias("row"))
    out = _ranked(rows, target.select(F.col(text).alias("text")), n_max, buckets, seed, percent, least_words)
    return out.where("rank is not null").select("row.*")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return (importance(docs, benchmark, n_max=1, seed=2024)
            .select("doc_id", "n_features", "weight", "score", "rank"))
