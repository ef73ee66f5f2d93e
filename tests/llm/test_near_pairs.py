import math
from collections import Counter

import brute
import numpy as np
from pyspark.sql import functions as F

from loadscope.llm import near_dup


def test_a_pair_is_left_to_a_bucket_that_it_is_in(spark):
    """Signature bytes that agree on an earlier band by chance, with other whole keys, are no shared bucket."""
    bands, _ = near_dup.shape(0.85)
    same = np.arange(near_dup.FUNCTIONS, dtype=np.uint8).tobytes()
    keys = {cid: [cid * 1000 + b for b in range(bands)] for cid in (1, 2, 3, 4)}
    for cid in (1, 2):
        keys[cid][3] = 77  # 1 and 2 share only this bucket
    for cid in (3, 4):
        keys[cid][2], keys[cid][5] = 88, 99  # 3 and 4 share two
    sigs = spark.createDataFrame([(c, same, k) for c, k in keys.items()], "cid long, sig binary, bands array<long>")
    rows = [(3, 77, 1), (3, 77, 2), (2, 88, 3), (2, 88, 4), (5, 99, 3), (5, 99, 4)]
    state = spark.createDataFrame([(b, k, c, c, 10) for b, k, c in rows], "band int, key long, cid long, comp long, n long")
    got = near_dup.in_question(state, sigs, 0.85, 85).collect()
    assert sorted(map(tuple, got)) == [(2, 88, 3), (2, 88, 4), (3, 77, 1), (3, 77, 2)]
    members = sigs.withColumn("hashes", F.lit(np.arange(10, dtype=np.uint64).tobytes()))
    assert sorted(map(tuple, near_dup.forest(state, members, 0.85, 85, "own = other").collect())) == [(1, 2), (3, 4)]
    other = members.withColumn("hashes", F.when(F.col("cid") == 1, F.lit(np.arange(5, 15, dtype=np.uint64).tobytes())).otherwise(F.col("hashes")))
    assert sorted(map(tuple, near_dup.forest(state, other, 0.85, 85, "own = other").collect())) == [(3, 4)]


def test_all_pruning_steps_together_meet_the_bound():
    """Probability, by steps, that a pair exactly at the threshold is pruned in one of them."""
    for t in (0.5, 0.8, 0.85, 0.95):
        match = t + (1 - t) / 256
        alive, done, pruned = np.ones(1), 0, 0.0
        for m, least in near_dup.least_matches(t):
            add = np.array([math.comb(m - done, i) * match ** i * (1 - match) ** (m - done - i) for i in range(m - done + 1)])
            alive, done = np.convolve(alive, add), m
            pruned, alive[:least] = pruned + alive[:least].sum(), 0.0
        assert pruned <= near_dup.PRUNE


def test_a_large_group_of_near_copies_makes_few_rows(spark, monkeypatch):
    """Near copies in a chain, so that no single text is near all of them, and others that share half, all in
    one bucket cut into small blocks: fewer rows than twice the members, and all components."""
    monkeypatch.setattr(near_dup, "BLOCK", 64)
    monkeypatch.setattr(near_dup, "SLAB", 16)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    texts, now = [], list(words)
    for i in range(500):
        now = list(now)
        now[int(rng.integers(0, 300))] = f"x{i}"
        texts.append(" ".join(now))
    texts += [" ".join(words[:150] + [f"z{i}_{j}" for j in range(150)]) for i in range(60)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = Counter(brute.near_components(rows, 3, 85))
    got = near_dup.near_duplicates(docs, 3, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == want

    members = (near_dup.profiles(docs, 3, 0.85, "doc_id", "text").withColumnRenamed("doc_id", "cid")
               .join(spark.createDataFrame([(i, near_dup.shingles(t, 3).tobytes()) for i, t in rows], "cid long, hashes binary"), "cid").cache())
    state = members.select(F.lit(0).alias("band"), F.lit(5).cast("long").alias("key"), "cid", F.col("cid").alias("comp"), "n")
    asked = near_dup.in_question(state, members.select("cid", "sig", "bands"), 0.85, 85)
    assert asked.count() <= len(rows)
    members = members.select("cid", "sig", "bands", "hashes")
    links, n = None, 0
    for which in near_dup.rounds(state):
        new = near_dup.forest(state, members, 0.85, 85, which).collect()
        n += len(new)
        links = spark.createDataFrame(new, "u long, v long") if links is None else links.union(spark.createDataFrame(new, "u long, v long"))
        named = dict(near_dup.components(links, "u", "v").collect())
        label = spark.createDataFrame(list(named.items()), "cid long, component long")
        state = state.drop("comp").join(label, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
    assert n < 2 * len(rows)
    assert Counter((d, n, named.get(d, d)) for d, n, _ in want) == want
