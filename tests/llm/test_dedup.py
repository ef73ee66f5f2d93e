from collections import Counter

import brute
from pyspark.sql import functions as F

from loadscope.llm import common, exact_dedup, near_dup, repeats


def test_exact_dedup(spark, edge, none, docs):
    for df in (edge, docs):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups = {}
        for d, t in rows:
            groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, d))
        want = Counter((d, min(groups[norm(t)])[3], len(groups[norm(t)])) for d, t in rows)
        got = exact_dedup.decisions(df).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
        kept = exact_dedup.kept_rows(df)
        assert kept.columns == df.columns
        assert sorted(norm(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.decisions(none).count() == 0 and exact_dedup.kept_rows(none).count() == 0


def test_near_dedup(spark, edge, none, docs):
    for df, k, percent in ((edge, 3, 85), (docs, 3, 85), (docs, 5, 80)):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = near_dup.near_duplicates(df, k, percent).collect()
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute.near_components(rows, k, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dup.near_duplicates(none).count() == 0
    kept = near_dup.kept_rows(edge, 3, 85)
    assert kept.columns == edge.columns
    # 4 has the words of 1 between other blanks; of the null ids one class is 1's.
    assert {r.doc_id for r in kept.collect()} >= {1, 5, 6, 7, 8, 9, 10, 11, 12, 13}


def test_near_dedup_of_one_large_group(spark):
    """Near copies of one text in a chain of edits: linked through neighbours only, one component."""
    words = [f"w{i}" for i in range(200)]
    rows, now = [], list(words)
    for d in range(60):
        rows.append((d, " ".join(now)))
        now = list(now)
        now[(d * 7) % 200] = f"edit{d}"
    rows += [(1000 + i, f"alone{i} " * 5 + f"tail{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df, 3, 85).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute.near_components(rows, 3, 85)


def test_bands_meet_the_miss_bound():
    for t in (0.5, 0.8, 0.85, 0.95):
        bands, rows = near_dup.shape(t)
        assert (1 - t ** rows) ** bands <= near_dup.MISS and bands * rows <= near_dup.MOST_HASHES


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = dict(common.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def repeats_of(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(df).collect())


def test_repeats(spark, edge, none, docs):
    for df in (edge, docs):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        assert repeats_of(df) == Counter((d, *x) for (d, _), x in zip(rows, brute.stripped([t for _, t in rows], repeats.WINDOW)))
    assert repeats.digest(none).count() == 0


def test_repeats_at_the_limit(spark):
    """Passages of 199, 200 and 201 bytes, shared at different offsets, and overlaps in one text."""
    import random
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passages = [text(n) for n in (199, 200, 201, 260, 700)]
    rows = [(i, text(r.randrange(300)) + p + text(r.randrange(300))) for i, p in enumerate(passages * 4)]
    rows += [(100, text(150) + passages[3][:230] + passages[3][30:] + text(10)), (101, "ab" * 500), (102, "q" * 200), (103, "q" * 199 + "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats_of(df) == Counter((d, *x) for (d, _), x in zip(rows, brute.stripped([t for _, t in rows], repeats.WINDOW)))


def test_index_family_merges_geometrically(spark):
    family = repeats.IndexFamily()
    found = [family.add(spark.createDataFrame([(i,), (i + 1,)], "head long")).collect() for i in range(4)]
    assert [sorted(r[0] for r in f) for f in found] == [[], [1], [2], [3]]
    assert sorted(family.levels) == [2]
    assert family.levels[2].agg(F.count("*")).first()[0] == 5
