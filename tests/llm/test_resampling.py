from collections import Counter

import brute
import pytest

from loadscope.llm import resampling

NAMES = ("doc_id", "n_features", "weight", "score", "rank")


def check(docs, target, **how):
    how = {"n_max": 1, "buckets": 10_000, "seed": 2024, "percent": 10, "least_words": 20} | how
    got = resampling.importance(docs, target, **how).select(*NAMES).collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute.resampled(rows, [r.text for r in target.select("text").collect()], how["n_max"], how["buckets"], how["seed"], how["percent"], how["least_words"])
    assert Counter(map(tuple, got)) == Counter(want)
    return got


@pytest.mark.parametrize("n_max", [1, 2])
def test_whole_table(spark, docs, n_max):
    got = check(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"), n_max=n_max)
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_edges(spark, edge, none):
    for how in ({}, {"n_max": 2, "buckets": 7}, {"least_words": 0, "percent": 50}, {"percent": 100, "least_words": 1}):
        check(edge, edge, **how)
    check(none, edge)
    check(edge, none)
    assert resampling.digest(none, none).count() == 0
    with pytest.raises(ValueError):
        resampling.importance(edge, edge, n_max=3)


def test_drawn_rows_keep_their_columns(edge):
    drawn = resampling.resampled(edge, edge, n_max=1, percent=50, least_words=1)
    ranked = resampling.importance(edge, edge, n_max=1, percent=50, least_words=1).where("rank is not null")
    assert drawn.columns == edge.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(r.doc_id for r in ranked.collect())


def test_head_and_tail_agree():
    words = [b"the", b"of", "été".encode(), b"x" * 500]
    full = resampling.Vocabulary(words, [(a, b) for a in words for b in words], 2, 97)
    empty = resampling.Vocabulary([], [], 2, 97)
    text = b" ".join(words * 3 + [b"unseen"])
    for (n, a), (m, b) in zip(full.pieces(text), empty.pieces(text)):
        assert n == m and a.tolist() == b.tolist()
    runs = [" ".join(r) for n in (1, 2) for t in [brute.plain_words(text.decode())] for r in zip(*[t[i:] for i in range(n)])]
    assert a.tolist() == [brute.crc32(r.encode()) % 97 for r in runs]


def test_head_is_bounded(spark):
    texts = spark.createDataFrame([(" ".join(f"w{i}" for i in range(20_000)) + " the" * 30_000 + " " + "y" * 300 + " z" * 100,)] * 3, "text string")
    v = resampling.vocabulary(texts, 2, 10)
    assert b"the" in v.states and b"z" in v.states and len(v.states) <= resampling.HEAD and (b"the", b"the") in v.pairs
