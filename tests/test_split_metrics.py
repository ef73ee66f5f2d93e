import random

import pytest
from pyspark.sql import functions as F

from loadscope.operators import metrics, split


@pytest.fixture(scope="module")
def balanced(spark):
    return spark.createDataFrame([(i, float(i % 7), 0 if i < 500 else 1) for i in range(1000)],
                                 "id long, feature_a double, target int")


@pytest.fixture(scope="module")
def imbalanced(spark):
    return spark.createDataFrame([(i, 0 if i < 986 else 1) for i in range(1000)], "id long, target int")


def test_split_sizes(balanced):
    s = split.stratified_split(balanced, "target", "id", 0.2, 42)
    c = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"train": 800, "test": 200}
    s3 = split.stratified_split(balanced, "target", "id", 0.3, 42)
    assert s3.filter(F.col("split") == "test").count() == 300
    per = {(r.split, r.target): r["count"] for r in s.groupBy("split", "target").count().collect()}
    assert per[("train", 0)] == 400 and per[("test", 1)] == 100


def test_split_disjoint_complete_repeatable(balanced):
    a = split.stratified_split(balanced, "target", "id", 0.2, 42)
    b = split.stratified_split(balanced, "target", "id", 0.2, 42)
    tr = a.filter(F.col("split") == "train").select("id")
    te = a.filter(F.col("split") == "test").select("id")
    assert tr.intersect(te).count() == 0
    assert tr.union(te).distinct().count() == 1000
    assert a.exceptAll(b).count() == 0


def test_imbalanced_ratio(imbalanced):
    s = split.stratified_split(imbalanced, "target", "id", 0.2, 42)
    r = {x.split: x.rate for x in s.groupBy("split").agg(F.avg("target").alias("rate")).collect()}
    assert abs(r["train"] - 0.014) < 0.01 and abs(r["test"] - 0.014) < 0.02


def test_single_class_raises(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "id long, target int")
    with pytest.raises(ValueError, match="at least 2 classes"):
        split.stratified_split(df, "target", "id")


def test_hash_rank_matches_full_sort(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(3000)], "id long, c int")
    got = {(r.id): r.hash_rank for r in split.hash_rank(df, "id", 7, ["c"], digits=2).collect()}
    import hashlib
    for c in range(3):
        ids = sorted([i for i in range(3000) if i % 3 == c], key=lambda i: (hashlib.md5(f"7|{i}".encode()).hexdigest(), i))
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_folds_and_undersample(balanced):
    f = split.assign_folds(balanced, "target", "id", 5)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes == [200] * 5
    u = split.undersample(balanced.filter((F.col("target") == 0) | (F.col("id") < 600)), "target", "id", 0.5)
    c = {r.target: r["count"] for r in u.groupBy("target").count().collect()}
    assert c == {1: 100, 0: 200}


def test_metrics_fixtures(spark):
    perfect = spark.createDataFrame([(0, 0, .1), (0, 0, .2), (1, 1, .8), (1, 1, .9)], "y int, pred int, p double")
    m = metrics.binary_metrics(perfect).first()
    assert (m.accuracy, m.precision, m.recall, m.f1, m.tp, m.fn) == (1.0, 1.0, 1.0, 1.0, 2, 0)
    assert metrics.ranking_metrics(perfect).first().roc_auc == 1.0
    hr = spark.createDataFrame([(1, 1)] * 5 + [(0, 1)] * 3 + [(0, 0)] * 2, "y int, pred int")
    m = metrics.binary_metrics(hr).first()
    assert (m.recall, m.tp, m.fp) == (1.0, 5, 3)
    none = spark.createDataFrame([(0, 0)] * 3, "y int, pred int")
    m = metrics.binary_metrics(none).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)


def test_auc_ap_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "y int, p double")
    r = metrics.cumulative_counts(df, buckets=7)
    got = metrics.ranking_metrics(df).first()
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    auc = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, tp, fp = 0.0, 0, 0
    for s in sorted({p for _, p in rows}, reverse=True):
        tp += sum(1 for y, p in rows if p == s and y == 1)
        fp += sum(1 for y, p in rows if p == s and y == 0)
        ap += sum(1 for y, p in rows if p == s and y == 1) / len(pos) * tp / (tp + fp)
    assert abs(got.roc_auc - auc) < 1e-9 and abs(got.average_precision - ap) < 1e-9
    assert r.filter(F.col("tp") > F.col("P")).count() == 0


def test_all_equal_scores_auc_half(spark):
    df = spark.createDataFrame([(1, .5), (0, .5), (1, .5), (0, .5)], "y int, p double")
    assert metrics.ranking_metrics(df).first().roc_auc == 0.5


def test_three_way_split_disjoint(balanced):
    s = split.three_way_split(balanced, "target", "id", 0.2, 0.2, 42)
    c = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"train": 600, "val": 200, "test": 200}
    assert s.select("id").distinct().count() == 1000


def test_group_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([(i, f"g{i % 37}") for i in range(2000)], "id long, g string")
    s = split.group_split(df, "g", 0.2, 42)
    per = s.groupBy("g").agg(F.countDistinct("split").alias("n")).filter(F.col("n") > 1).count()
    assert per == 0
    assert s.filter(F.col("split") == "test").select("g").distinct().count() == 8  # ceil(0.2 * 37)
