"""Operator 11: benchmark decontamination through a distributed positional inverted index.

The corpus' words are stored once as postings, sharded by document: a block of about ``BLOCK_WORDS``
words holds, for each of its terms, the number of occurrences and their positions (gaps in the
narrowest integer that fits). Searching takes three steps. The postings of the searched terms alone
are kept, and give the exact corpus frequency of each. A phrase is sent to the blocks that hold its
rarest term, the key salted by block so that a frequent one is split. In a block, the phrase's lists,
shifted by each term's offset, are intersected from the rarest on until nothing is left or all
agree. Blocks are bounded, and phrases stream past a block's lists, so a task's memory grows with
neither table. Terms are compared as words, not as hashes: matches are exact.

``phrase_matches`` returns every occurrence of a word sequence, ``near_matches`` every shortest run
of at most ``span`` words of one document that holds all words of a query in any order.

Null or wordless text: a document without words, an item without windows. A document longer than a
block continues in the next one, which repeats its last ``REACH`` words. Repeated rows, ids and
null ids: rows of their own; an item_id that repeats is one item, a null one has no name and is
left out of the items. Empty table on either side: no hits. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from loadscope.llm.common import dropped, partitions, saved
from loadscope.llm.plain_words import GAP, boundaries, coded, word_lists

BLOCK_BYTES = 1 << 24
#: Longest phrase or span that the index serves.
REACH = 64
#: Parts into which the blocks of a frequent term are dealt.
SLICES = 16
DOC, POSTING, SEARCH = 0, 1, 2
INDEX = "block long, kind int, term string, n int, first int, gaps binary, row long, at long"


class Block:
    """The lower-cased texts of one block while it is read."""

    def __init__(self):
        self.texts: list[bytes] = []
        self.docs: list[tuple] = []  # row, words of the row before, id
        self.size = 0

    def add(self, text: bytes, row: int, at: int, doc_id) -> None:
        self.texts.append(text)
        self.docs.append((row, at, doc_id))
        self.size += len(text) + 1

    def coded(self) -> None:
        """Codes the words; a word's place is its number in the block, plus one for each text that has begun."""
        begins = np.cumsum([0] + [len(t) + 1 for t in self.texts[:-1]])
        starts, self.codes, self.terms = coded(b" ".join(self.texts))
        doc = np.searchsorted(begins, starts, "right") - 1
        self.places = np.arange(len(starts)) + doc + 1
        self.n = np.bincount(doc, minlength=len(self.docs))
        self.starts = np.cumsum(self.n) - self.n + np.arange(len(self.docs)) + 1

    def postings(self) -> Iterator[tuple[list, np.ndarray, np.ndarray, pa.Array]]:
        """(terms, counts, first positions, gaps) of the terms, by the width that their gaps need."""
        terms = self.terms
        order = np.sort(self.codes << 32 | self.places)  # by term, then by place
        counts = np.bincount(order >> 32, minlength=len(terms))
        order &= 0xFFFFFFFF
        starts = np.cumsum(counts) - counts
        gaps = np.diff(order, prepend=0)
        firsts = order[starts] if len(terms) else order
        gaps[starts] = 0
        widest = np.maximum.reduceat(gaps, starts) if len(terms) else gaps
        inner = np.ones(len(order), bool)
        inner[starts] = False
        owner = np.repeat(np.arange(len(terms)), counts)
        for low, dtype in ((0, "u1"), (1 << 8, "<u2"), (1 << 16, "<u4")):
            mine = (widest >= low) & (widest < 1 << 8 * np.dtype(dtype).itemsize)
            if not mine.any():
                continue
            data = gaps[inner & mine[owner]].astype(dtype).tobytes()
            ends = np.cumsum((counts[mine] - 1) * np.dtype(dtype).itemsize)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
            yield [terms[i] for i in np.flatnonzero(mine)], counts[mine], firsts[mine], packed


def _pieces(data: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """A text in pieces of about ``size`` bytes, each with the number of words before it; a piece repeats the
    last ``REACH`` words of the one before."""
    at = before = 0
    while len(data) - at > size:
        gap = GAP.search(data, at + size)
        if not gap:
            break
        starts, _ = boundaries(data[at:gap.start()])
        if len(starts) <= REACH:  # long words: a piece must bring more than it repeats
            size *= 2
            continue
        yield data[at:gap.start()], before
        before += len(starts) - REACH
        at += int(starts[-REACH])
    yield data[at:], before


def _index(id_type: pa.DataType, block_bytes: int):
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["block", "kind", "term", "n", "first", "gaps", "row", "at", "doc_id"]
        number, rows, block = 0, 0, Block()

        def batch(kind: int, count: int, **columns) -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), id_type]
            given = {"block": np.full(count, part << 32 | number), "kind": np.full(count, kind, np.int32)} | columns
            cells = [pa.nulls(count, t) if c not in given else given[c] if isinstance(given[c], pa.Array) else pa.array(given[c], t)
                     for c, t in zip(names, types)]
            return pa.RecordBatch.from_arrays(cells, names)

        def written() -> Iterator[pa.RecordBatch]:
            nonlocal number, block
            if block.docs:
                block.coded()
                row, at, ids = map(list, zip(*block.docs))
                yield batch(DOC, len(ids), first=block.starts.astype(np.int32), n=block.n.astype(np.int32), row=row, at=at, doc_id=ids)
                for terms, counts, firsts, gaps in block.postings():
                    for i in range(0, len(terms), 20_000):
                        j = slice(i, i + 20_000)
                        yield batch(POSTING, len(terms[j]), term=pa.array(terms[j], pa.binary()).cast(pa.string()), n=counts[j].astype(np.int32),
                                    first=firsts[j].astype(np.int32), gaps=gaps[j])
            number, block = number + 1, Block()

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                row = part << 32 | rows
                rows += 1
                for piece, before in _pieces((text or b"").lower(), block_bytes):
                    if block.docs and block.size + len(piece) > block_bytes:
                        yield from written()
                    block.add(piece, row, before, doc_id)
        yield from written()
    return indexed


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The positional inverted index of all rows as a written table: rows of kind ``DOC`` (a document's
    place in a block) and of kind ``POSTING`` (a term's positions in a block)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"]
    schema = StructType.fromDDL(INDEX).add("doc_id", kind.dataType)
    return saved(rows.mapInArrow(_index(to_arrow_type(kind.dataType), block_bytes), schema), "postings")


def positions_of(n: int, first: int, gaps: bytes) -> np.ndarray:
    width = len(gaps) // (n - 1) if n > 1 else 1
    return np.cumsum(np.concatenate([[first], np.frombuffer(gaps, f"<u{width}")]), dtype=np.int64)


def within(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted


def phrase_places(terms: list[tuple[int, str]], lists) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of a phrase in a block; ``terms`` are (offset, term), rarest first."""
    found = None
    for offset, term in terms:
        held = lists(term)
        if held is None:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = held - offset if found is None else found[within(held, found + offset)]
        if not len(found):
            break
    return found, np.full(len(found), len(terms), np.int64)


def near_places(span: int):
    def places(terms: list[tuple[int, str]], lists) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the shortest runs holding all terms: for every place where a term
        ends a run, the run goes back to the earliest of the terms' last places."""
        kept = [lists(t) for t in dict.fromkeys(t for _, t in terms)]
        if any(k is None for k in kept):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rare = kept[0]
        for i, k in enumerate(kept):  # places within the span of the rarest term's
            j = np.searchsorted(rare, k)
            before, after = k - rare[np.maximum(j - 1, 0)], rare[np.minimum(j, len(rare) - 1)] - k
            kept[i] = k[(np.abs(before) < span) | (np.abs(after) < span)]
        ends = np.unique(np.concatenate(kept))
        start = np.full(len(ends), np.iinfo(np.int64).max)
        for k in kept:
            j = np.searchsorted(k, ends, "right") - 1
            start = np.minimum(start, np.where(j >= 0, k[np.maximum(j, 0)] if len(k) else -1, -1))
        fresh = start > np.concatenate([[-1], start[:-1]])
        size = ends - start + 1
        hit = fresh & (start >= 0) & (size <= span)
        return start[hit], size[hit]
    return places


def _searched(places):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, docs, table, stored, decoded = None, [], None, {}, {}

        def lists(term: str) -> np.ndarray | None:
            if term not in decoded:
                decoded[term] = positions_of(*stored.pop(term)) if term in stored else None
            return decoded[term]

        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            c = b.to_pydict()
            for i, (at_block, kind) in enumerate(zip(c["block"], c["kind"])):
                if at_block != block:
                    block, docs, table, stored, decoded = at_block, [], None, {}, {}
                if kind == DOC:
                    docs.append((c["first"][i], c["n"][i], c["row"][i], c["at"][i]))
                elif kind == POSTING:
                    stored[c["term"][i]] = (c["n"][i], c["first"][i], c["gaps"][i])
                else:
                    if table is None:
                        table = np.array(sorted(docs), np.int64).T
                    start, size = places([(t["at"], t["term"]) for t in c["terms"][i]], lists)
                    if not len(start):
                        continue
                    doc = np.searchsorted(table[0], start, "right") - 1
                    inside = start + size <= table[0][doc] + table[1][doc]
                    doc, start, size = doc[inside], start[inside], size[inside]
                    for column, values in zip(out, (np.full(len(doc), c["search"][i]), table[2][doc], start - table[0][doc] + table[3][doc], size)):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["search", "row", "pos", "size"])
    return search


def _matches(postings: DataFrame, searches: DataFrame, places) -> DataFrame:
    """(search, row, pos, size) of ``searches`` (search long, words array): written, each match once."""
    spark = postings.sparkSession
    longest = searches.agg(F.max(F.size("words"))).first()[0] or 0
    if longest > REACH:
        raise ValueError(f"a search of {longest} words is over the index' reach of {REACH}")
    terms = searches.select("search", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))
    held = saved(postings.where(F.col("kind") == POSTING).select("block", "kind", "term", "n", "first", "gaps")
                 .join(terms.select("term").distinct(), "term", "left_semi"), "searched-postings")
    frequency = held.groupBy("term").agg(F.sum("n").alias("freq"))
    # A search with a term that no block holds has no match and drops out here.
    plans = terms.join(frequency, "term").groupBy("search", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "at", "term"))).alias("terms"))
    plans = saved(plans.where(F.size("terms") == F.col("n")).select("search", "terms"), "search-plans")
    slices = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
    keyed = plans.select("search", "terms", F.col("terms")[0]["term"].alias("term"), slices.alias("slice"))
    where = held.select("block", "term", F.pmod(F.hash("block"), F.lit(SLICES)).alias("slice"))
    sent = where.join(keyed, ["term", "slice"]).select("block", F.lit(SEARCH).alias("kind"), "search", "terms")
    blocks = sent.select("block").distinct()
    places_of = postings.where(F.col("kind") == DOC).select("block", "kind", "n", "first", "row", "at").join(blocks, "block", "left_semi")
    stream = held.unionByName(places_of, allowMissingColumns=True).unionByName(sent, allowMissingColumns=True)
    stream = stream.repartition(partitions(spark), "block").sortWithinPartitions("block", "kind")
    found = saved(stream.mapInArrow(_searched(places), "search long, row long, pos long, size long"), "matches")
    dropped(spark, held, plans)
    return found.distinct()  # the words that two blocks of a long document share


def phrase_matches(postings: DataFrame, phrases: DataFrame) -> DataFrame:
    """(search, row, pos, size): every place where the words of a search stand in a row, in order."""
    return _matches(postings, phrases.where(F.size("words") > 0), phrase_places)


def near_matches(postings: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """(search, row, pos, size): every shortest run of at most ``span`` words of one row that holds all
    words of a search, in any order (a word that a search repeats counts once)."""
    if span > REACH:
        raise ValueError(f"a span of {span} is over the index' reach of {REACH}")
    return _matches(postings, queries.where(F.size("words") > 0), near_places(span))


def _cut(size: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(items: list, words: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(words, pa.list_(pa.string()))], ["item", "words"])

        for b in batches:
            for item, text in zip(b.column("item").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                tail, cut = [], 0
                for words in word_lists(text):
                    tail += [w.decode() for w in words]
                    n = max(0, len(tail) - size + 1)
                    for i in range(0, n, 5000):
                        some = [tail[j:j + size] for j in range(i, min(n, i + 5000))]
                        yield batch([item] * len(some), some)
                    tail, cut = tail[n:], cut + n
                if tail and not cut:
                    yield batch([item], [tail])
    return windows


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (names of the items with windows in the text, sorted), per row."""
    spark = docs.sparkSession
    postings = index(docs, doc_id, text)
    named = saved(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("string").alias("name"),
                                   F.col(item_text).alias("text")), "items")
    cuts = saved(named.select("item", "text").mapInArrow(_cut(size), "item long, words array<string>"), "cuts")
    windows = saved(cuts.select("words").distinct().withColumn("search", F.monotonically_increasing_id()), "windows")
    found = saved(phrase_matches(postings, windows), "found")

    spans = found.groupBy("row", "pos").agg(F.max("size").alias("size")).withColumn("end", F.col("pos") + F.col("size"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("end") - F.greatest("pos", F.least("end", F.coalesce(before, F.lit(0))))
    hits = spans.select("row", new.alias("hit")).groupBy("row").agg(F.sum("hit").alias("n_hit"))

    owners = windows.join(cuts, "words").join(named.select("item", "name"), "item").where("name is not null").select("search", "name").distinct()
    items = (found.select("row", "search").distinct().join(owners, "search").groupBy("row")
             .agg(F.array_sort(F.collect_set("name")).alias("items")))
    rows = postings.where(F.col("kind") == DOC).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max(F.col("at") + F.col("n")).alias("n_words"))
    out = rows.join(hits, "row", "left").join(items, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    return contamination(docs, benchmark, size).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
