import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loadscope.llm import common, quality


def test_every_trusted_character_counts(spark):
    """One long trusted text, more than 500 short ones and repeated rows: the model knows all of them."""
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(i, "x", text(20_000)) for i in range(6)] + [(100 + i, "y", text(40)) for i in range(1500)]
    rows += [rows[0], (50, "x", rows[1][2]), (None, "x", rows[2][2]), (60, "x", ""), (61, "x", None), (62, "z", "abc"), (63, None, "abc")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    trusted = df.where("doc_id is not null").select("doc_id")
    held = {tuple(x): x.h for x in df.where("text is not null").select("doc_id", "lang", "text", quality.held_out("text").alias("h")).collect()}
    got = quality.judged(df, trusted).collect()
    assert len(got) == len(rows)
    by = {(x.doc_id, x.lang): x for x in got}
    taught = {(lang, t) for d, lang, t in rows if d is not None and t and lang and not next(h for k, h in held.items() if k[:3] == (d, lang, t))}
    for d, lang, t in rows:
        if (lang, t) in taught:
            assert by[d, lang].perplexity < 20  # letters at random: 26 where nothing is known
    # The joins give what a model of the same texts in one process gives.
    model = quality.Model(*quality.train(spark.createDataFrame(sorted(taught), "lang string, text string")))
    n, total = model.score([t for _, _, t in rows], [lang for _, lang, _ in rows])
    for (d, lang, _), count, s in zip(rows, n, total):
        x = by[d, lang]
        assert x.n_scored == count and (x.perplexity is None) == (count == 0)
        assert not count or abs(np.log(x.perplexity) + s / count) < 1e-4


def test_what_chunks_hand_on_is_small(spark, monkeypatch):
    """The texts and n-grams that stay on disk until the end take less than the input: a row a shard, not a row an n-gram,
    and no join or other shuffle moves the texts on their way into the chunks."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows, sizes, plans = {}, {}, {}

    class Done(Exception):
        pass

    def saved(df, name, *partition_by):
        if name == "counts":
            raise Done
        out = common.saved(df, name, *partition_by)
        rows[name] = rows.get(name, 0) + out.count()
        sizes[name] = sizes.get(name, 0) + sum(p.stat().st_size for p in Path(out._scratch.removeprefix("file:")).rglob("*.parquet"))
        plans[name] = df._jdf.queryExecution().toString()
        return out

    monkeypatch.setattr(quality, "saved", saved)
    with pytest.raises(Done):
        quality.perplexities(docs.select("doc_id", "lang", "text"), labels.where("quality = 1").select(F.col("doc_id").alias("_t")))
    assert "Join" not in plans["chunks"] and "Exchange" not in plans["chunks"]
    assert rows["pieces"] < 1000
    assert sizes["chunks"] + sizes["pieces"] < 1.5 * Path("/root/testdata/sf0.01/documents.parquet").stat().st_size


@pytest.mark.parametrize("table", (1 << 24, 10))
def test_grams_of_a_chunk(monkeypatch, table):
    """Numbered by marks or by sorting: every n-gram that ends in a character, with its texts and counts, in the same order."""
    monkeypatch.setattr(quality, "TABLE", table)
    r = random.Random(7)
    texts = ["".join(r.choice("ab céüß") for _ in range(n)) for n in (1, 3, 5, 400, 2000)] + ["a", "  ", "a\0b"]
    grams = quality.Grams(texts, 64)
    pieces = list(grams.pieces(np.bincount(grams.at, minlength=len(grams.shard)).astype(float)))
    listed = ["".join(chr(x) for x in g) for g in grams.points]
    want = Counter()
    for i, t in enumerate(texts):
        t = "\0" * (quality.ORDER - 1) + " ".join(t.replace("\0", " ").split(" ")) if t.strip() else "\0\0\0\0 "
        while "  " in t:
            t = t.replace("  ", " ")
        want.update((i, t[j:j + quality.ORDER]) for j in range(len(t) - quality.ORDER + 1))
    assert Counter((i, listed[g]) for i, g in zip(grams.of, grams.at)) == want
    assert len(set(listed)) == len(listed) and list(grams.shard) == sorted(grams.shard)
    counts = Counter()
    for _, n, g, c in pieces:
        names = quality.split(quality.unpacked(pa.chunked_array([[g]]), [n], 4 * quality.ORDER).decode("utf-32-le")).to_pylist()
        counts.update(dict(zip(names, np.frombuffer(quality.unpacked(pa.chunked_array([[c]]), [n], 8)))))
    whole = Counter()
    for (_, g), n in want.items():
        whole[g] += n
    assert counts == whole
    again = quality.Grams(texts[::-1], 64)
    assert (again.points == grams.points).all()
