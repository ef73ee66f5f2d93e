from collections import Counter

import brute
from pyspark.sql import functions as F

from loadscope.llm import merkle

NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")


def check(docs):
    got = merkle.digest(docs).collect()
    want = brute.merkle([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()], 4)
    assert Counter(tuple(r[c] for c in NAMES) for r in got) == Counter(want)
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    return got


def test_whole_table(docs):
    got = check(docs)
    assert {r.verified for r in got} == {True, False}


def test_edges(spark, edge, none):
    check(edge)
    assert merkle.digest(none).count() == 0 and merkle.build(none.select("doc_id", F.col("lang").alias("key"), F.lit("a").alias("node"))).root is None
    one = edge.where("doc_id = 8")
    assert check(one)[0].subroot == check(one)[0].leaf == check(one)[0].root
    check(edge.withColumn("lang", F.lit("en")))
    check(edge.withColumn("lang", F.lit(None).cast("string")))


def test_trees_of_many_levels_and_many_trees(spark):
    rows = spark.range(0, 6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("S"), F.col("id") % 7).alias("source"),
                                       F.when(F.col("id") < 5000, F.lit("hot")).otherwise(F.concat(F.lit("l"), F.col("id"))).alias("lang"),
                                       (F.col("id") % 3).alias("n_chars"), F.concat(F.lit("Text "), F.col("id")).alias("text"))
    got = check(rows)
    assert sum(not r.verified for r in got) > 1000
    check(rows.where("doc_id between 4400 and 5000").union(rows.where("doc_id = 4500")).union(rows.where("doc_id = 4500")))


def test_saved_manifest_proves_and_finds_changes(spark, docs, tmp_path):
    leaves = docs.select("doc_id", F.col("lang").alias("key"), merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("node"))
    built = merkle.build(leaves)
    merkle.save(built, str(tmp_path / "m"))
    back = merkle.load(spark, str(tmp_path / "m"))
    assert back.root == built.root
    proofs = merkle.proofs(back).collect()
    assert len(proofs) == docs.count()
    for p in proofs:
        path = [s.asDict() for s in p.path]
        assert merkle.fold(p.leaf, path) == built.root and merkle.fold(p.subroot, path) != built.root
    assert merkle.build(leaves.where("doc_id <> 3")).root != built.root


def test_only_every_third_level_is_stored(spark):
    leaves = spark.range(0, 5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
    built = merkle.build(leaves)
    assert [t.count() for t in built.trees] == [5000, 10, 1]
