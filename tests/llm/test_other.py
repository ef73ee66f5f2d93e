import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from loadscope.llm import language_id, mixing, quality, sharding, top_k


def check_mix(df):
    rows = mixing.mix(df).collect()
    size = lambda t: len(brute.WORD.findall(t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r.doc_id, r.source, size(r.text)) for r in df.select("doc_id", "source", "text").collect())
    total, words, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        total[r.source] += r.size
        words[r.source] += r.taken
        target[r.source] = r.target
    names = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, capped = {}, set()
    left = 1.5 * sum(total.values())
    while True:  # the law, as it is told
        free = [s for s in names if s not in capped]
        rest = left - sum(2 * total[s] for s in capped)
        want = {s: 2.0 * total[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if want[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    largest = max((r.size for r in rows), default=0)
    for s in names:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(words[s] - want[s]) <= max(0.02 * want[s], largest)
    return rows


def test_mix(spark, edge, none, docs):
    rows = check_mix(docs)
    check_mix(edge)
    again = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})
    for df in (edge,):
        copies = Counter()
        for r in mixing.mix(df).collect():
            copies[r.doc_id, r.source] += r.copies
        assert Counter((r.doc_id, r.source) for r in mixing.mixed_rows(df).collect()) == +copies
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0


def test_language_id(spark, edge, none, docs):
    rows = language_id.digest(docs).collect()
    lang = dict(docs.select("doc_id", "lang").collect())
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    got = {r.doc_id: r.lang_pred for r in language_id.digest(edge).collect()}
    assert {d for d, x in got.items() if x == "und"} == {5, 6, 7, 9}
    assert language_id.digest(none).count() == 0
    blank = language_id.predict(edge, edge.where("lang is null"))
    assert {r.lang_pred for r in blank.collect()} == {"und"}
    kept = language_id.accepted_rows(edge, edge)
    assert kept.columns == edge.columns
    assert {5, 6, 7, 9}.isdisjoint(r.doc_id for r in kept.collect())


def test_phrases_are_the_fewest_longest_matches():
    samples = [("a", b"the cat sat on the mat"), ("b", b"le chat est sur le mur")]
    model = language_id.Languages(samples)
    texts = ["the cat on mur", "le chat zz", "q"]
    raw, sizes, _ = language_id.plain(texts)
    got = model.phrases(raw, sizes)
    for i, (_, sample) in enumerate(samples):
        for j, text in enumerate(texts):
            t, n, at = text.encode(), 0, 0
            while at < len(t):
                size = 1
                while at + size < len(t) + 1 and t[at:at + size] in sample:
                    size += 1
                at += max(1, size - 1)
                n += 1
            assert got[i, j] == n


def test_quality(spark, edge, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.digest(docs, labels).collect()
    assert len(rows) == docs.count()
    good, bad = ({r.doc_id for r in labels.where(f"quality = {q}").collect()} for q in (1, 0))
    kept = {r.doc_id for r in rows if r.kept}
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.2 * len(bad)
    got = {r.doc_id: r for r in quality.judged(edge, edge.where("doc_id in (1, 3, 8)").select("doc_id")).collect()}
    assert got[5].perplexity is None and not got[5].kept and got[9].threshold is None and got[9].kept
    assert got[1].kept and not got[10].kept
    assert quality.judged(none, none.select("doc_id")).count() == 0


def test_kneser_ney_probabilities_sum_to_one(spark):
    text = "abab abba baab cab " * 8
    arrays = quality.train(spark.createDataFrame([("x", text)], "lang string, text string"))
    model = quality.Model(*arrays)
    alphabet = sorted(set(text))
    for context in ("abab", "cab ", "zzzz", "\0\0\0\0"):
        points = [np.array([ord(c) for c in context + a], np.uint64) for a in alphabet]
        total = sum(float(np.exp(model.logs(p, np.zeros(len(p), np.int64)))[0]) for p in points)
        unknown = float(np.exp(model.logs(np.array([ord(c) for c in context + "@"], np.uint64), np.zeros(5, np.int64)))[0])
        assert total + unknown == pytest.approx(1, abs=1e-4)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(100)]  # ties
    rows += [(600, None), (620, [1.0, None] * 4), (640, [float("nan")] * 8), (660, [float("inf")] * 8), (680, [1.0] * 5), (None, [1.0] * 8), (20, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("block", F.lit("x"))
    fine = [(i, [int(np.floor(64.0 * float(np.float32(x)))) for x in v] + [0] * (8 - len(v)))
            for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for i, q in fine:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)[:20]
            want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(best))
    got = top_k.digest(df).select("query_id", "rank", "vec_id", "score").collect()
    assert Counter(tuple(r) for r in got) == want
    assert top_k.digest(df.where("1 = 0")).count() == 0


def test_shards(spark, edge, none, docs):
    for df in (edge, docs):
        rows = sharding.digest(df, 40).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        counts = [len(slots.get(s, [])) for s in range(40)]
        assert set(slots) <= set(range(40)) and max(counts) - min(counts) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_bytes = defaultdict(int)
    for r in sharding.shards(docs, 8, law="bytes").collect():
        by_bytes[r.shard] += r.size
    largest = max(r.size for r in sharding.shards(docs, 8, law="bytes").collect())
    mean = sum(by_bytes.values()) / 8
    assert all(abs(by_bytes[s] - mean) <= largest for s in range(8))
    assert sharding.digest(none, 40).count() == 0


def test_hilbert_curve_is_a_walk():
    """Every cell once, and each step goes to a neighbouring cell."""
    for n, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        axes = np.stack([a.ravel() for a in np.meshgrid(*[np.arange(side)] * n, indexing="ij")])
        index = sharding.hilbert_index(axes, bits)
        assert sorted(index) == list(range(side ** n))
        path = axes[:, np.argsort(index)]
        assert (np.abs(np.diff(path, axis=1)).sum(0) == 1).all()
