"""Operator 2: token ids in a binary file format: canonical length-limited Huffman codes.

Written in three passes over distributed data:

1. every text is encoded by the tokenizers library, an end id is appended, documents are dealt by
   ascending doc_id into shards (one partition each) and packed into blocks of whole documents;
2. the ids are counted over all blocks; the counts (at most one row per vocabulary id) give
   optimal code lengths of at most ``MAX_BITS`` bits by package-merge, and canonical codes;
3. every block is coded on its own: a bit string, the bit offset of every ``STRIDE``-th id as a
   checkpoint, and the doc_ids and lengths of its documents.

Layout under ``path``: ``codebook`` (id, bits) and ``blocks/shard=N`` (block, start, n_tokens,
doc_ids, counts, checkpoints, payload), both Parquet. Shards, blocks within a shard and documents
within a block ascend by doc_id (null first). A block needs nothing but the codebook; its
checkpoints let all strides of a block be decoded side by side from a table of 2^bits entries.

Null text: the empty text (only the end id). Repeated doc_ids: kept as rows of their own, next to
each other. Empty table: an empty codebook and no blocks, read back as no rows. Extra columns are
not read. A block holds at least one document, so a very long text makes a longer block.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscope.llm.bpe import CACHE, ROWS, SHORT, UNSAFE, Words, byte_letters
from loadscope.llm.common import dropped, held, partitions, range_part, saved, small
from loadscope.session import scratch_path

MAX_BITS = 20
STRIDE = 256
BLOCK_TOKENS = 1 << 17
#: Characters of texts that are cut into words at a time.
AT_ONCE = 4_000_000
#: Marks at the end of a word, and (RE2) ends of words, letters and digits, after which they are a pretoken.
MARKS, ENDS = ".,;:!?", "[A-Za-z0-9\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]$"

class Known:
    """Words that a worker has met (the first ``CACHE``, none very long), in Arrow, and their ids one after the other."""

    def __init__(self, kind: np.dtype):
        self.words, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, kind), np.zeros(1, np.int64)

    def look_up(self, distinct: pa.Array, make: Callable[[list[str]], tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all known and of the distinct words, and for each of these start and end in them;
        new ones are made, as their ids one after the other and the end of each."""
        place = pc.index_in(distinct, value_set=self.words)
        new = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        words = distinct.take(pa.array(new))
        made, more = make(words.to_pylist())
        ids, ends = np.concatenate([self.ids, np.array(made, self.ids.dtype)]), np.concatenate([self.ends, self.ends[-1] + np.array(more, np.int64)])
        at = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at[new] = len(self.words) + np.arange(len(new))
        room = CACHE - len(self.words)
        if room > 0 and len(new):
            # Up to the first very long word, if there is one.
            long = np.flatnonzero(pc.utf8_length(words).to_numpy() > SHORT)
            n = min(room, len(new), *long[:1].tolist())
            self.words = pa.concat_arrays([self.words, words.slice(0, n)])
            self.ends = ends[:len(self.words) + 1].copy()
            self.ids = ids[:self.ends[-1]].copy()
        return ids, np.stack([ends.take(at), ends.take(at + 1)])


def library(path: str) -> tuple:
    """(tokenizer, ids of a text without added tokens, added tokens, type of an id, words met, ids of words)."""
    def load() -> tuple:
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        model, letters = t.model, {chr(b): c for c, b in byte_letters().items()}
        table, code = str.maketrans(letters), "H" if t.get_vocab_size() <= 1 << 16 else "I"

        def part(word: str) -> bytes:
            if word.isascii() and word.isprintable() and " " not in word[1:]:
                mapped = letters[" "] + word[1:] if word[0] == " " else word
            else:
                mapped = word.encode().decode("latin-1").translate(table)
            return array(code, [x.id for x in model.tokenize(mapped)]).tobytes()

        added = [x.content for x in t.get_added_tokens_decoder().values()]
        kind, blank, tokenize = np.dtype("<u2" if code == "H" else "<u4"), letters[" "], model.tokenize
        words = Words(part)

        def made(new: list[str]) -> tuple[list[int], list[int]]:
            """The ids of the words, each with a blank in front, and the end of each."""
            ids, ends = [], []
            for x in new:
                if x.isalpha():
                    ids += [y.id for y in tokenize(blank + (x if x.isascii() else x.encode().decode("latin-1").translate(table)))]
                else:
                    ids += array(code, words[" " + x])
                ends.append(len(ids))
            return ids, ends

        return t, words, added, kind, Known(kind), made

    return held(("tokenizers", path), load)


def library_ids(path: str, text: str) -> bytes:
    """Ids by the tokenizers library with add_special_tokens=False, in the type of an id. Its model
    merges each distinct pretoken once per worker; texts that hold an added token go to it whole."""
    t, words, added, kind, *_ = library(path)
    if any(a in text for a in added):
        return np.array(t.encode(text, add_special_tokens=False).ids, kind).tobytes()
    return words.text(text)


def all_ids(path: str, texts: list[str]) -> list[bytes]:
    """``library_ids`` of many texts. They are cut at their spaces and the words numbered in Arrow, so that a word
    that many texts hold is looked up once; texts where a space is no boundary go by themselves."""
    _, words, added, kind, known, made = library(path)
    out: list = [None] * len(texts)
    cut = [i for i, x in enumerate(texts) if not (UNSAFE.search(x) or any(a in x for a in added))]
    for i in set(range(len(texts))).difference(cut):
        out[i] = library_ids(path, texts[i])
    start = 0
    while start < len(cut):
        end, size = start, 0
        while end < len(cut) and (end == start or size + len(texts[cut[end]]) <= AT_ONCE):
            size += len(texts[cut[end]])
            end += 1
        rows = cut[start:end]
        pieces = pc.split_pattern(pa.array([texts[i] for i in rows], pa.large_string()), " ")
        first = pieces.offsets.to_numpy()
        after = np.ones(len(pieces.values), bool)
        after[first[:-1]] = False  # the only pieces without a blank in front
        heads = pieces.values.take(pa.array(first[:-1])).to_pylist()
        numbered = pieces.values.filter(pa.array(after)).dictionary_encode()
        # Each piece is a word and the marks at its end: a pretoken of their own after a letter or a digit.
        distinct = numbered.dictionary
        bare = pc.utf8_rtrim(distinct, MARKS)
        bare = pc.if_else(pc.match_substring_regex(bare, ENDS), bare, distinct)
        size = pc.binary_length(bare).to_numpy()
        marked = np.flatnonzero(size < pc.binary_length(distinct).to_numpy())
        marks = [words[x.encode()[k:].decode()] for x, k in zip(distinct.take(pa.array(marked)).to_pylist(), size.take(marked).tolist())]
        bare = bare.dictionary_encode()
        ids, bounds = known.look_up(bare.dictionary, made)
        at = np.zeros((2, len(distinct), 2), np.int64)  # (start or end, piece, word or marks)
        at[:, :, 0] = bounds.take(bare.indices.to_numpy(), axis=1)
        ends = len(ids) + np.cumsum(np.fromiter(map(len, marks), np.int64, len(marks)) // kind.itemsize)
        at[0, marked, 1], at[1, marked, 1] = np.concatenate([[len(ids)], ends[:-1]])[:len(ends)], ends
        ids = np.concatenate([ids, np.frombuffer(b"".join(marks), kind)])
        number = numbered.indices.to_numpy()
        at, n = at[0].take(number, axis=0).ravel(), (at[1] - at[0]).take(number, axis=0).ravel()
        ends = np.cumsum(n)
        found = ids.take(np.repeat(at - (ends - n), n) + np.arange(n.sum()))
        ends = ends[1::2]
        # Ids before each text: a text has a piece less than its offsets say.
        bounds = np.concatenate([[0], ends]).take(first - np.arange(len(first))).tolist()
        for i, head, a, b in zip(rows, heads, bounds, bounds[1:]):
            out[i] = (words[head] if head else b"") + found[a:b].tobytes()
        start = end
    return out


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``limit`` bits for positive counts (package-merge).

    Level by level the sorted symbols and the pairs of the level before are merged; then, from the
    last level back, the first 2n-2 items say how many of the cheapest symbols get one bit more."""
    n = len(counts)
    if n <= 2:
        return np.ones(n, np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both, mark = np.concatenate([leaves, pairs]), np.arange(n + len(pairs)) < n
        by = np.argsort(both, kind="stable")
        level, mark = both[by], mark[by]
        is_leaf.append(mark)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for mark in reversed(is_leaf):
        used = int(mark[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Codes in the order of (bits, id); each is the one before plus one, shifted to its length."""
    codes, code, last = np.zeros(len(ids), np.uint64), 0, 0
    for i in np.lexsort((ids, bits)):
        code <<= int(bits[i]) - last
        last = int(bits[i])
        codes[i] = code
        code += 1
    return codes


def coded(ids: np.ndarray, code: np.ndarray, bits: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, checkpoints): the codes one after the other, highest bit first, in 32-bit big-endian
    words, and the bit offset of every STRIDE-th id (uint64)."""
    n = bits[ids]
    offset = np.cumsum(n) - n
    wide = code[ids] << (np.uint64(64) - n.astype(np.uint64) - (offset & 31).astype(np.uint64))
    word = offset >> 5
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out = np.zeros(int(word[-1]) + 3, np.uint64)  # the bits of different codes are disjoint: sums are unions
    out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes(), offset[::STRIDE].astype("<u8").tobytes()


def decode_table(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) for every value of the next ``width`` bits."""
    width = int(bits.max()) if len(bits) else 1
    symbol, length = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    codes = canonical(ids, bits)
    for i in range(len(ids)):
        lo, hi = int(codes[i]) << (width - int(bits[i])), (int(codes[i]) + 1) << (width - int(bits[i]))
        symbol[lo:hi], length[lo:hi] = ids[i], bits[i]
    return symbol, length, width


def decoded(payload: bytes, checkpoints: bytes, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All strides in lockstep: look the next bits of every stride up, take the id, move on."""
    symbol, length, width = table
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    ahead = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at, last = np.frombuffer(checkpoints, "<u8").astype(np.int64), 8 * len(payload)
    out = np.empty((STRIDE, len(at)), np.uint32)
    for step in range(STRIDE):
        key = (ahead[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[step] = symbol[key]
        at = np.minimum(at + length[key], last)
    return out.T.ravel()[:n]


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, doc_id: str = "doc_id",
                     text: str = "text") -> str:
    """Encodes and writes all rows of ``docs``; ``path`` is a new folder of any file system of Spark."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    part = range_part(rows, "doc_id", n)
    kind = library(tokenizer)[3]
    tail = np.array([] if end_id is None else [end_id], kind).tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                ids = [x + tail for x in all_ids(tokenizer, b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(ids, pa.binary())],
                                                 ["doc_id", "part", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, start, held, size, shard = 0, 0, [], 0, 0

        def out():
            counts = [len(x) // kind.itemsize for _, x in held]
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int64()), "start": pa.array([start], pa.int64()),
                "n_tokens": pa.array([sum(counts)], pa.int64()), "doc_ids": pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
                "counts": pa.array([counts], pa.list_(pa.int64())), "ids": pa.array([b"".join(x for _, x in held)], pa.binary())})

        for batch in batches:
            for d, p, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "ids"))):
                if held and size + len(x) > kind.itemsize * BLOCK_TOKENS:
                    yield out()
                    block, start, held, size = block + 1, start + size // kind.itemsize, [], 0
                shard = p
                held.append((d, x))
                size += len(x)
        if held:
            yield out()

    dealt = (rows.withColumn("part", part.cast("int")).mapInArrow(tokenize, "doc_id long, part int, ids binary")
             .repartitionById(n, "part").sortWithinPartitions("doc_id"))
    raw = saved(dealt.mapInArrow(pack, "shard int, block long, start long, n_tokens long, doc_ids array<bigint>, "
                                       "counts array<bigint>, ids binary"), "token-blocks")
    dropped(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                got = np.bincount(np.frombuffer(x.as_py(), kind))
                if len(got) > len(total):
                    got, total = total, got.astype(np.int64)
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["id", "n"])

    counts = sorted(map(tuple, raw.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect()))
    used, freq = np.array([c[0] for c in counts], np.int64), np.array([c[1] for c in counts], np.int64)
    bits = code_lengths(freq, MAX_BITS)
    small(spark, list(zip(used.tolist(), bits.tolist())), "id long, bits long").coalesce(1).write.parquet(f"{path}/codebook")
    before, at = {}, 0
    for shard, size in sorted(map(tuple, raw.groupBy("shard").agg(F.sum("n_tokens")).collect())):  # one row per partition
        before[shard] = at
        at += size
    shared = spark.sparkContext.broadcast((used, bits))

    def dense(used: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = int(used.max()) + 1 if len(used) else 1
        code, length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        code[used], length[used] = canonical(used, bits), bits
        return code, length

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = held(("codes", path), lambda: dense(*shared.value))
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                payload, marks = coded(np.frombuffer(b.column("ids")[0].as_py(), kind), codes, lengths)
                start = b.column("start")[0].as_py() + before[b.column("shard")[0].as_py()]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in ("shard", "block")), pa.array([start], pa.int64()),
                     *(b.column(c) for c in ("n_tokens", "doc_ids", "counts")), pa.array([marks], pa.binary()),
                     pa.array([payload], pa.binary())],
                    ["shard", "block", "start", "n_tokens", "doc_ids", "counts", "checkpoints", "payload"])

    (raw.where("n_tokens > 0").mapInArrow(code, BLOCKS).write.option("compression", "zstd").partitionBy("shard")
     .parquet(f"{path}/blocks"))
    dropped(spark, raw)
    return path


BLOCKS = ("shard int, block long, start long, n_tokens long, doc_ids array<bigint>, counts array<bigint>, checkpoints binary, "
          "payload binary")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids as little-endian unsigned 32-bit integers."""
    rows = spark.read.schema("id long, bits long").parquet(f"{path}/codebook").collect()  # at most the vocabulary
    shared = spark.sparkContext.broadcast((np.array([r.id for r in rows], np.int64), np.array([r.bits for r in rows], np.int64)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held(("table", path), lambda: decode_table(*shared.value))
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                ids = decoded(get("payload"), get("checkpoints"), get("n_tokens"), table)
                counts = np.array(get("counts"), np.int64)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(get("doc_ids"), pa.int64()), pa.array(ends - counts + get("start")), pa.array(counts),
                     pa.array([ids[e - c:e].astype("<u4").tobytes() for c, e in zip(counts, ends)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    if not rows:
        return small(spark, [], "doc_id long, start long, n_tokens long, ids binary")
    return (spark.read.schema(BLOCKS).parquet(f"{path}/blocks").drop("shard")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary"))


def digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, from the files."""
    path = write_token_file(docs, scratch_path(docs.sparkSession, "tokens"), tokenizer, end_id)
    return read_token_file(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
