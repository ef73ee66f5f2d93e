"""Operator 9: byte-level BPE encoding and decoding with a contiguous rank array.

A text is cut into chunks at spaces, a chunk into pretokens by the tokenizer's pattern, and a
pretoken is merged in two parallel arrays: the part boundaries and the rank of the pair that starts
at each part. The minimum rank is searched again and again, its boundary is deleted and the ranks
of the two neighbouring pairs are refreshed. Pretokens over ``SHORT`` bytes use a heap of (rank,
position) with linked parts instead, so that a very long run of letters costs n log n. Both give
the merges of the lowest rank, leftmost first, as the tokenizer defines them.

Null text: encoded as the empty text (no ids, empty decoded text). Repeated rows, ties and extra
columns: every row is encoded on its own. Empty table: empty result with the same schema.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadscope.llm.common import held

#: Fixed values of byte-level BPE: the pretoken pattern and Unicode's white space (its White_Space property).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+|[" + WHITE + "]+(?![^" + WHITE + "])|["
           + WHITE + "]+")
SHORT = 256
#: The rank of a pair that no merge joins.
NONE = 1 << 60
#: Words that a worker keeps encoded (the first it meets); bounds its memory.
CACHE = 300_000
#: Rows that a worker handles at a time.
ROWS = 500
#: A cut before a space is a pretoken boundary unless the space stands between white space, or ends the text after some.
UNSAFE = re.compile(f" (?<=[{WHITE}] )(?:[{WHITE}]|\\Z)")


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the
    others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def chunks(text: str) -> list[str] | None:
    """The text cut before its spaces, or None where such a cut is not a pretoken boundary."""
    if UNSAFE.search(text):
        return None
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + x for x in rest]


class Words(dict):
    """Chunk -> ids, made by ``part(pretoken)`` when first looked up. A chunk of letters, with or without
    a blank in front, is one pretoken; others are cut by the pattern."""

    def __init__(self, part: Callable[[str], bytes]):
        self.part, self.cut = part, regex.compile(PATTERN).findall

    def __missing__(self, chunk: str) -> bytes:
        if (chunk[1:] if chunk[:1] == " " else chunk).isalpha() or len(pieces := self.cut(chunk)) == 1:
            got = self.part(chunk)
        else:
            got = b"".join([self[p] for p in pieces])
        if len(self) < CACHE and len(chunk) <= SHORT:
            self[chunk] = got
        return got

    def text(self, text: str) -> bytes:
        cut = chunks(text)
        return b"".join(map(self.__getitem__, self.cut(text) if cut is None else cut))


class Bpe:
    """Encoder and decoder of one tokenizer file (byte-level BPE, JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        raw = lambda s: bytes(letters[c] for c in s)
        self.id_of = {raw(k): v for k, v in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.joined: list[int] = []
        for i, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            left, right = raw(left), raw(right)
            self.rank.setdefault((self.id_of[left], self.id_of[right]), i)
            self.joined.append(self.id_of[left + right])
        self.of_byte = [self.id_of[bytes([b])] for b in range(256)]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {k: np.uint32(v).tobytes() for k, v in added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        size = 1 + max([*self.id_of.values(), *added.values()])
        self.bytes_of = [b""] * size
        for k, v in [*self.id_of.items(), *((k.encode(), v) for k, v in added.items())]:
            self.bytes_of[v] = k
        self.words = Words(self.part)

    def merge_short(self, ids: list[int]) -> list[int]:
        """Contiguous ranks: ``ranks[i]`` belongs to the pair that starts at part i."""
        rank, joined = self.rank.get, self.joined
        ranks = [rank(p, NONE) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            ids[i] = joined[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        rank, joined, n = self.rank, self.joined, len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = joined[r], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (r := rank.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [x for x, a in zip(ids, alive) if a]

    def part(self, word: str) -> bytes:
        ids = [self.of_byte[b] for b in word.encode()]
        ids = self.merge_short(ids) if len(ids) <= SHORT else self.merge_long(ids)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split_added is not None:
            pieces = self.split_added.split(text)
            if len(pieces) > 1:
                return b"".join(self.added[p] if i % 2 else self.words.text(p) for i, p in enumerate(pieces))
        return self.words.text(text)

    def decode(self, ids: bytes) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def loaded(path: str) -> Bpe:
    return held(("bpe", path), lambda: Bpe(path))


def added_column(df: DataFrame, source: str, name: str, kind: T.DataType, arrow: pa.DataType,
                 function: Callable[[object], list]) -> DataFrame:
    """``df`` with a column made from ``source`` by ``function(list of values) -> list``, in small batches."""
    if name in df.columns:
        df = df.drop(name)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = pa.array(function(part.column(source).to_pylist()), arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, name])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``: the ids of the whole text as little-endian unsigned 32-bit integers. ``tokenizer``
    is the path of a byte-level BPE file that every executor has."""
    return added_column(docs, text, ids, T.BinaryType(), pa.binary(),
                        lambda values: [loaded(tokenizer).encode(v or "") for v in values])


def decode(frame: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``: the text of the ids (null ids: the empty text)."""
    return added_column(frame, ids, text, T.StringType(), pa.string(),
                        lambda values: [loaded(tokenizer).decode(v or b"") for v in values])


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of (doc_id, text)."""
    coded = decode(encode(docs.select("doc_id", "text"), tokenizer).drop("text"), tokenizer)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
