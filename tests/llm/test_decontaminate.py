from collections import Counter

import brute
import numpy as np
from pyspark.sql import functions as F

from loadscope.llm import decontaminate


def check(docs, items, size=10):
    got = decontaminate.contamination(docs, items, size)
    want = brute.contaminated([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], size)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == Counter(want)
    return want


def test_whole_table(spark, docs):
    want = check(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    assert any(w[2] for w in want)


def test_edges(spark, edge, none):
    prose = edge.where("doc_id = 1").first().text
    words = prose.split()
    items = [(10, prose), (9, " ".join(words[5:17]).upper()), (9, "ab ab ab"), (8, "One, two!"), (7, None), (6, "..."), (None, " ".join(words[:11])),
             (5, "x " * 40 + "y"), (4, "DéJà Là"), (3, "ab " * 30), (11, "zz yy"), (12, "word1 of1 word2")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("name", F.lit(1)).withColumn("words", F.lit(2)).withColumn("row", F.lit("r"))
    want = check(edge, bench)
    assert {w[0] for w in want if w[2]} >= {1, 2, 3, 4, 8, 10, 13, 14}
    check(edge, bench, size=1)
    check(none, bench)
    check(edge, bench.where("1 = 0"))
    ids = edge.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert dict(decontaminate.digest(ids, bench).dtypes)["doc_id"] == "string"


def test_long_document_goes_on_in_other_blocks(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 3000, 700_000)]
    cut = [i for i in range(0, 700_000, 90_001)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w1 w2")], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(words[c:c + 14])) for i, c in enumerate(cut)], "item_id long, text string")
    postings = decontaminate.index(docs, block_bytes=600_000)
    assert postings.select("block").distinct().count() > 3
    phrases = items.select(F.col("item_id").alias("search"), F.split("text", " ").alias("words"))
    got = {(r.search, r.row, r.pos, r["size"]) for r in decontaminate.phrase_matches(postings, phrases).collect()}
    row = postings.where("kind = 0 and doc_id = 1").first().row
    assert got == {(i, row, c, 14) for i, c in enumerate(cut)}
    every = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    where = {}
    for i, e in enumerate(every):
        where.setdefault(e, []).append(i)
    some = list(where)[::40_000]  # phrases from all over the text, block borders included
    border = spark.createDataFrame([(i, e.split()) for i, e in enumerate(some)], "search long, words array<string>")
    got = Counter((r.search, r.pos) for r in decontaminate.phrase_matches(postings, border).collect())
    assert got == Counter((i, p) for i, e in enumerate(some) for p in where[e])


def test_proximity(spark):
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(f"t{x}" for x in rng.zipf(1.3, 300) if x < 60)) for i in range(30)] + [(30, None), (31, "t1"), (32, "t9 t1 t9 t1 t3 t2")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    searches = [["t1", "t2"], ["t9", "t1", "t3"], ["t1"], ["t1", "t1", "t5"], ["t7", "nowhere"], ["t20", "t30", "t2"], []]
    queries = spark.createDataFrame(list(enumerate(searches)), "search long, words array<string>")
    postings = decontaminate.index(docs, block_bytes=3_000)
    names = {r.row: r.doc_id for r in postings.where("kind = 0").collect()}
    for span in (1, 5, 12):
        got = Counter((r.search, names[r.row], r.pos, r["size"]) for r in decontaminate.near_matches(postings, queries, span).collect())
        want = Counter((q, d, s, n) for q, wanted in enumerate(searches) if wanted for d, t in texts for s, n in brute.covers(brute.plain_words(t), wanted, span))
        assert got == want


def test_reach(spark, docs):
    import pytest
    postings = decontaminate.index(docs)
    long = spark.createDataFrame([(1, ["a"] * 65)], "search long, words array<string>")
    with pytest.raises(ValueError):
        decontaminate.phrase_matches(postings, long)
    with pytest.raises(ValueError):
        decontaminate.near_matches(postings, long, 65)


def test_words_are_coded_exactly():
    rng = np.random.default_rng(7)
    letters = list("abcxyz09éß日") + ["A", "Q"]
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 40, 3000)] + ["a" * n for n in range(1, 40)] * 3 + ["a" * 8 + "b" * n for n in range(10)]
    text = "".join(w + " .,\n-"[i % 5] for i, w in enumerate(words)).encode().lower()
    starts, codes, terms = decontaminate.coded(text)
    want = brute.PLAIN.findall(text.decode())
    assert [terms[c].decode() for c in codes] == want and len(terms) == len(set(terms))
    assert [text[s:].startswith(w.encode()) for s, w in zip(starts, want)] == [True] * len(want)
    assert [list(x) for x in decontaminate.coded(b"")] == [[], [], []] and decontaminate.coded(b" ..")[2] == []


def test_pieces_of_a_text_overlap():
    text = " ".join(f"w{i}" for i in range(5000)).encode()
    for size in (100, 700, 5000, 10**6):
        seen = {}
        for piece, before in decontaminate._pieces(text, size):
            for i, w in enumerate(piece.split()):
                assert seen.setdefault(before + i, w) == w
        assert [seen[i] for i in range(5000)] == text.split() and len(seen) == 5000
    assert [p for p, _ in decontaminate._pieces(b"x" * 5000, 10)] == [b"x" * 5000]
