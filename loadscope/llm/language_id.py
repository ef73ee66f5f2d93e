"""Operator 5: language ID by cross-parsing entropy.

A suffix automaton is built of labelled text of each language. A text is parsed greedily against
each automaton: walk on while the automaton has the next letter, else the phrase ends and the next
one starts at that letter. A phrase is thus a longest match with the language's text, and phrases
per letter estimate the cross entropy; the language that needs the fewest wins (ties: the first in
code-point order). The score is 1 - best / second best, or 1 if only one language is learned.

Text is lower-cased, every run of other characters than letters is one blank, and letters are read
as UTF-8 bytes, so the alphabet is bounded for every script. Whole texts are parsed; a text of more
than ``SEGMENT`` bytes is parsed in segments, all segments of a batch and all languages in lockstep
over one transition table. The labelled sample is bounded: ``SAMPLE_BYTES`` for all languages
together, shared equally, taken in hash order as windows of at most ``WINDOW_CHARS`` characters
from at most ``SAMPLE_DOCS`` rows of a language. Only this sample reaches the driver.

Null text or no letter: `und`, score 0. Null labels do not teach; with no labelled letters at all,
every text is `und`. Repeated rows are predicted alike. Empty table: no rows. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscope.llm.common import held

SAMPLE_BYTES = 80_000
SAMPLE_DOCS = 200
WINDOW_CHARS = 2_000
SEGMENT = 2_048
ROWS = 400
UNDETERMINED = "und"

_ALPHA: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point -> is a letter."""
    if not _ALPHA:
        _ALPHA.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _ALPHA[0]


def plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, bytes of each text, whether it has a letter): lower
    case, runs of non-letters as one blank."""
    joined = "\0".join(t.replace("\0", " ") for t in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    cut = points == 0
    is_letter = letters()[points]
    points = np.where(is_letter | cut, points, 32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    doc = np.cumsum(cut)
    has = np.bincount(doc[is_letter], minlength=len(texts)) > 0
    raw = np.frombuffer(points[keep].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    ends = np.append(np.flatnonzero(raw == 0), len(raw))
    sizes = np.diff(np.concatenate([[-1], ends])) - 1
    return raw[raw != 0], sizes[: len(texts)], has


class Languages:
    """The automata of all languages in one transition table."""

    def __init__(self, samples: list[tuple[str, bytes]]):
        self.names = [n for n, _ in samples]
        used = sorted(set(b"".join(s for _, s in samples)))
        self.width = len(used) + 1  # code 0: a byte that no sample has
        self.code = np.zeros(256, np.int64)
        self.code[used] = np.arange(1, self.width)
        tables, roots, base = [], [], 0
        for _, sample in samples:
            t = self.automaton(self.code[np.frombuffer(sample, np.uint8)].tolist(), base)
            tables.append(t)
            roots.append(base)
            base += len(t)
        self.table = np.concatenate(tables).ravel()
        self.roots = np.array(roots, np.int64)
        first = np.stack([self.table[r * self.width:(r + 1) * self.width] for r in roots]).astype(np.int64)
        self.known = first >= 0
        self.first = np.where(self.known, first, self.roots[:, None])

    def automaton(self, text: list[int], base: int) -> np.ndarray:
        """Suffix automaton, letter by letter; state 0 is the start. Rows: states, columns: letters."""
        steps, link, length, last = [{}], [-1], [0], 0
        for c in text:
            new = len(steps)
            steps.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in steps[p]:
                steps[p][c] = new
                p = link[p]
            if p >= 0:
                q = steps[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(steps)
                    steps.append(dict(steps[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and steps[p].get(c) == q:
                        steps[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        table = np.full((len(steps), self.width), -1, np.int32)
        for s, row in enumerate(steps):
            for c, to in row.items():
                table[s, c] = to + base
        return table

    def phrases(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(languages x texts) number of phrases of each text."""
        codes = self.code[raw]
        pieces = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(sizes, pieces) - nth * SEGMENT)
        by = np.argsort(-size, kind="stable")
        start, size, doc = start[by], size[by], doc[by]
        count = np.zeros((len(self.names), len(size)), np.int64)
        state = np.repeat(self.roots[:, None], len(size), 1)
        alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for step, k in enumerate(alive):
            c = codes[start[:k] + step]
            went = self.table[state[:, :k] * self.width + c].astype(np.int64)
            stuck = went < 0
            # The phrase ends, if one was begun; a letter that the language lacks is a phrase of its own.
            count[:, :k] += stuck & (state[:, :k] != self.roots[:, None])
            count[:, :k] += stuck & ~self.known[:, c]
            state[:, :k] = np.where(stuck, self.first[:, c], went)
        count += state != self.roots[:, None]
        out = np.zeros((len(self.names), len(sizes)), np.int64)
        for lang in range(len(self.names)):
            out[lang] = np.bincount(doc, count[lang], minlength=len(sizes))
        return out


def sample(labelled: DataFrame, text: str, lang: str) -> list[tuple[str, bytes]]:
    """The bounded labelled sample, one (language, plain bytes) each, languages in code-point order."""
    h = F.xxhash64(F.col(text))
    start = F.pmod(h, F.greatest(F.lit(1), F.length(text) - F.lit(WINDOW_CHARS - 1))) + 1
    rows = (labelled.where(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
            .select(F.col(lang).cast("string").alias("lang"), h.alias("h"), F.substring(F.col(text), start.cast("int"), F.lit(WINDOW_CHARS)).alias("piece"))
            .dropDuplicates(["lang", "h"]))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= SAMPLE_DOCS)
    found: dict[str, list] = {}
    for r in rows.collect():  # at most SAMPLE_DOCS windows a language
        found.setdefault(r.lang, []).append((r.n, r.piece))
    each = max(1_000, SAMPLE_BYTES // max(1, len(found)))
    out = []
    for name in sorted(found):
        raw, _, _ = plain([" ".join(p for _, p in sorted(found[name]))])
        if len(raw):
            out.append((name, raw.tobytes()[:each]))
    return out


def predict(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
            more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, lang_pred, score and rate (phrases per byte, null for `und`) of every row of ``docs``, plus
    the columns ``more`` (of the input's columns) carried along."""
    learned = sample(labelled, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # SAMPLE_BYTES at most
    rows = docs.select(*[c.alias(n) for n, c in (more or {}).items()], F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    carried = rows.schema.names[:-1]
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]) + ", lang_pred string, score double, rate double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned_now = shared.value
        model = held(("languages", tuple(learned_now)), lambda: Languages(learned_now)) if learned_now else None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                raw, sizes, has = plain([t or "" for t in b.column("_text").to_pylist()])
                names, scores, rates = [UNDETERMINED] * b.num_rows, np.zeros(b.num_rows), [None] * b.num_rows
                if model is not None and has.any():
                    n = model.phrases(raw, sizes)
                    best = n.argmin(0)
                    low = n.min(0)
                    rest = np.sort(n, 0)[1] if len(n) > 1 else np.maximum(low, 1) * np.inf
                    for i in np.flatnonzero(has):
                        names[i], rates[i] = model.names[best[i]], float(low[i] / sizes[i])
                        scores[i] = 1.0 - float(low[i]) / float(rest[i])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in carried), pa.array(names), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
                    [*carried, "lang_pred", "score", "rate"])

    return rows.mapInArrow(run, out_schema).withColumnRenamed("_id", "doc_id")


#: A text that needs more phrases a byte than this fits none of the learned languages.
NO_FIT = 0.65


def accepted_rows(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, with all their columns."""
    carried = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    out = predict(docs, labelled, doc_id, text, lang, carried)
    return out.where((F.col("lang_pred") != UNDETERMINED) & (F.col("rate") <= NO_FIT)).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that never teaches: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    out = predict(docs, docs.where(~held_out()), more={"held_out": held_out()})
    return out.select("doc_id", "held_out", "lang_pred", "score", "rate")
