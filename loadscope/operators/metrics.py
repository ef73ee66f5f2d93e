"""Classification evaluation.

Scale notes
-----------
* Threshold metrics (M1, M2, M6, J7) are one scan with conditional sums per threshold —
  the threshold list never gets joined to the rows.
* Curve metrics (M3-M5, M8) need prefix sums over scores in descending order. The rows
  are first reduced to one row per distinct score (map-side combine). Distinct scores are
  then cut into score buckets at approximate quantiles (``percentile_approx`` — a small
  array collected to the driver), so each bucket is an even share of the distinct scores.
  Per-bucket totals (one row per bucket) give each bucket its offset; the running sum
  inside a bucket is a window partitioned by bucket. No window ever runs without a
  partition key over data that grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscope.functions import fixed


def _div0(a: Column, b: Column) -> Column:
    """a / b with zero division -> 0.0 (the studied system's convention)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# --------------------------------------------------------------------------- M1, M2
def confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """M1: TN/FP/FN/TP with labels fixed to {0, 1} (safe when a class is absent)."""
    yy, pp = F.col(y), F.col(pred)
    return df.agg(
        F.sum(F.when((yy == 0) & (pp == 0), 1).otherwise(0)).cast("bigint").alias("tn"),
        F.sum(F.when((yy == 0) & (pp == 1), 1).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when((yy == 1) & (pp == 0), 1).otherwise(0)).cast("bigint").alias("fn"),
        F.sum(F.when((yy == 1) & (pp == 1), 1).otherwise(0)).cast("bigint").alias("tp"))


def metrics_from_counts(df: DataFrame, digits: int = 4) -> DataFrame:
    """M2 from tn/fp/fn/tp columns: accuracy, precision, recall, F1 (zero division -> 0)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = _div0(tp, tp + fp)
    rec = _div0(tp, tp + fn)
    f1 = _div0(prec * 2.0 * rec, prec + rec)
    acc = _div0(tp + tn, tp + tn + fp + fn)
    return df.select("*", F.round(acc, digits).alias("accuracy"), F.round(prec, digits).alias("precision"),
                     F.round(rec, digits).alias("recall"), F.round(f1, digits).alias("f1"))


def binary_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return metrics_from_counts(confusion(df, y, pred))


# --------------------------------------------------------------------------- J7 / M6
def threshold_table(scored: DataFrame, thresholds, y: str = "y", p: str = "p") -> DataFrame:
    """J7 + M1/M2 for many thresholds in ONE scan: conditional sums per threshold, then the
    one-row result is stacked to one row per threshold."""
    thresholds = list(thresholds)
    yy, pp = F.col(y), F.col(p)
    aggs = []
    for i, t in enumerate(thresholds):
        hit = pp >= F.lit(float(t))
        aggs += [F.sum(F.when(hit & (yy == 1), 1).otherwise(0)).cast("bigint").alias(f"tp{i}"),
                 F.sum(F.when(hit & (yy == 0), 1).otherwise(0)).cast("bigint").alias(f"fp{i}"),
                 F.sum(F.when(~hit & (yy == 1), 1).otherwise(0)).cast("bigint").alias(f"fn{i}"),
                 F.sum(F.when(~hit & (yy == 0), 1).otherwise(0)).cast("bigint").alias(f"tn{i}")]
    one = scored.agg(*aggs)
    parts = ", ".join(f"CAST({float(t)!r} AS DOUBLE), tp{i}, fp{i}, fn{i}, tn{i}" for i, t in enumerate(thresholds))
    long = one.selectExpr(f"stack({len(thresholds)}, {parts}) as (threshold, tp, fp, fn, tn)")
    return metrics_from_counts(long)


def threshold_tiers(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """M6: recall tiers and precision tiers with 'caught' text and false alarms."""
    t = threshold_table(scored, fixed.RECALL_TIERS + fixed.PRECISION_TIERS, y, p)
    return t.select("threshold", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1",
                    F.concat(F.col("tp").cast("string"), F.lit("/"), (F.col("tp") + F.col("fn")).cast("string"))
                    .alias("caught"), F.col("fp").alias("false_alarms"))


# --------------------------------------------------------------------------- M3-M5, M8
def score_counts(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row per distinct score: positives and negatives at exactly that score."""
    return scored.groupBy(F.col(p).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).cast("bigint").alias("neg"))


def cumulative_counts(scored: DataFrame, y: str = "y", p: str = "p", buckets: int = 256) -> DataFrame:
    """Distinct scores with inclusive running counts from the top score down:
    ``tp`` = positives with score >= s, ``fp`` = negatives with score >= s, plus totals."""
    sc = score_counts(scored, y, p)
    n = buckets
    if n > 1:
        qs = [i / n for i in range(1, n)]
        bounds = sc.agg(F.percentile_approx("score", qs, 10000).alias("b")).first()["b"] or []
        bounds = sorted(set(float(b) for b in bounds))
    else:
        bounds = []
    # Binary-search bucketing (Bucketizer): a higher score lands in a higher bucket id.
    from pyspark.ml.feature import Bucketizer
    splits = [float("-inf")] + bounds + [float("inf")]
    sc = (Bucketizer(splits=splits, inputCol="score", outputCol="_b", handleInvalid="keep").transform(sc)
          .withColumn("bucket", F.col("_b").cast("int")).drop("_b"))
    per = sc.groupBy("bucket").agg(F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"))
    # The per-bucket table has at most `n` rows: an unpartitioned window over it is tiny.
    wb = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    off = per.select("bucket", F.coalesce(F.sum("bpos").over(wb), F.lit(0)).alias("opos"),
                     F.coalesce(F.sum("bneg").over(wb), F.lit(0)).alias("oneg"))
    tot = per.agg(F.sum("bpos").alias("P"), F.sum("bneg").alias("N"))
    wi = Window.partitionBy("bucket").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    j = sc.join(F.broadcast(off), "bucket")  # <= n rows: bounded broadcast
    P = tot.select("P").scalar()
    N = tot.select("N").scalar()
    return j.select("score", "pos", "neg",
                    (F.col("opos") + F.sum("pos").over(wi)).cast("bigint").alias("tp"),
                    (F.col("oneg") + F.sum("neg").over(wi)).cast("bigint").alias("fp"),
                    P.cast("bigint").alias("P"), N.cast("bigint").alias("N"))


def curve_points(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """M5: ROC (fpr, tpr) and PR (recall, precision) point per distinct threshold."""
    c = cumulative_counts(scored, y, p)
    return c.select(F.col("score").alias("threshold"), "tp", "fp",
                    _div0(F.col("fp"), F.col("N")).alias("fpr"), _div0(F.col("tp"), F.col("P")).alias("tpr"),
                    _div0(F.col("tp"), F.col("P")).alias("recall"),
                    _div0(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def ranking_metrics(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """M3 ROC-AUC with ties (0.0 without scores) and M4 step-wise average precision."""
    c = cumulative_counts(scored, y, p)
    auc_term = F.col("neg").cast("double") * (F.col("tp").cast("double") - F.col("pos") * 0.5)
    ap_term = F.col("pos").cast("double") * _div0(F.col("tp"), F.col("tp") + F.col("fp"))
    g = c.agg(F.sum(auc_term).alias("_auc"), F.sum(ap_term).alias("_ap"),
              F.max("P").alias("P"), F.max("N").alias("N"))
    return g.select(_div0(F.col("_auc"), F.col("P") * F.col("N")).alias("roc_auc"),
                    _div0(F.col("_ap"), F.col("P")).alias("average_precision"))


def best_threshold(scored: DataFrame, y: str = "y", p: str = "p", metric: str = "f1",
                   min_recall: float = 0.80) -> DataFrame:
    """M8: threshold maximising F1 on the PR curve (2PR/(P+R+1e-9)), ties -> lower threshold;
    ``metric='recall'``: highest threshold with recall >= min_recall (D6)."""
    pts = curve_points(scored, y, p)
    if metric == "recall":
        ok = pts.filter(F.col("recall") >= min_recall)
        return ok.agg(F.max("threshold").alias("best_threshold"))
    f1 = F.col("precision") * 2.0 * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9)
    return pts.agg(F.max_by("threshold", F.struct(f1, -F.col("threshold"))).alias("best_threshold"),
                   F.max(f1).alias("best_f1"))


# --------------------------------------------------------------------------- M7, M9, M10, J8
def class_report(df: DataFrame, y: str = "y", pred: str = "pred", digits: int = 4) -> DataFrame:
    """M7: per class precision/recall/F1/support + macro and weighted averages."""
    g = df.groupBy(F.col(y).alias("_y"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    per = g.groupBy().agg(*[
        F.sum(F.when((F.col("_y") == k) & (F.col("_p") == k), F.col("n")).otherwise(0)).alias(f"tp{k}") for k in (0, 1)
    ], *[F.sum(F.when(F.col("_p") == k, F.col("n")).otherwise(0)).alias(f"pp{k}") for k in (0, 1)],
        *[F.sum(F.when(F.col("_y") == k, F.col("n")).otherwise(0)).alias(f"s{k}") for k in (0, 1)])
    rows = []
    for k in (0, 1):
        pr = _div0(F.col(f"tp{k}"), F.col(f"pp{k}"))
        rc = _div0(F.col(f"tp{k}"), F.col(f"s{k}"))
        rows.append((str(k), pr, rc, _div0(pr * 2.0 * rc, pr + rc), F.col(f"s{k}")))
    base = per.select(*[c.alias(f"{n}_{k}") for k, *cs in rows for n, c in zip(("p", "r", "f", "s"), cs)])
    tot = F.col("s_0") + F.col("s_1")
    out = []
    for k in ("0", "1"):
        out.append(F.struct(F.lit(k).alias("label"), F.col(f"p_{k}").alias("precision"), F.col(f"r_{k}").alias("recall"),
                            F.col(f"f_{k}").alias("f1"), F.col(f"s_{k}").alias("support")))
    for name, w0, w1 in (("macro avg", F.lit(0.5), F.lit(0.5)),
                         ("weighted avg", _div0(F.col("s_0"), tot), _div0(F.col("s_1"), tot))):
        out.append(F.struct(F.lit(name).alias("label"),
                            (F.col("p_0") * w0 + F.col("p_1") * w1).alias("precision"),
                            (F.col("r_0") * w0 + F.col("r_1") * w1).alias("recall"),
                            (F.col("f_0") * w0 + F.col("f_1") * w1).alias("f1"), tot.alias("support")))
    r = base.select(F.explode(F.array(*out)).alias("r")).select("r.*")
    return r.select("label", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("bigint").alias("support"))


def safety_status(recall: Column) -> Column:
    """M9."""
    return (F.when(recall >= 0.90, fixed.SAFETY_STATUS[0])
            .when(recall >= 0.75, fixed.SAFETY_STATUS[1])
            .otherwise(fixed.SAFETY_STATUS[2]))


def report_rows(scored: DataFrame, name: str, thresholds, y: str = "y", p: str = "p") -> DataFrame:
    """Report rows per threshold: ROC-AUC, PR-AUC, precision/recall/accuracy in percent
    (2 dp), F1 (4 dp), TP and FP. Ranking metrics are computed once (one-row result read
    back as two numbers); all thresholds share one scan."""
    rk = ranking_metrics(scored, y, p).first()
    t = threshold_table(scored, thresholds, y, p)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec, rec = _div0(tp, tp + fp), _div0(tp, tp + fn)
    return t.select(
        F.lit(name).alias("model"), "threshold",
        F.round(F.lit(float(rk["roc_auc"])), 4).alias("roc_auc"),
        F.round(F.lit(float(rk["average_precision"])), 4).alias("pr_auc"),
        F.round(prec * 100.0, 2).alias("precision_pct"), F.round(rec * 100.0, 2).alias("recall_pct"),
        F.round(_div0(prec * 2.0 * rec, prec + rec), 4).alias("f1"),
        F.round(_div0(tp + tn, tp + tn + fp + fn) * 100.0, 2).alias("accuracy_pct"), "tp", "fp")


def ranked_report(rows: DataFrame, by: str = "f1") -> DataFrame:
    """T4: report rows in order: thresholds upwards, best ``by`` first, models by name; ``place`` is the
    position within the threshold. A report has a few rows for each threshold."""
    w = Window.partitionBy("threshold").orderBy(F.col(by).desc(), "model")
    return rows.withColumn("place", F.row_number().over(w)).orderBy("threshold", "place")


def compare_metrics(base: DataFrame, new: DataFrame, tol: float = 0.001) -> DataFrame:
    """Full outer join on metric name; missing -> 0; delta and arrow (+/- tol)."""
    j = base.select("metric", F.col("value").alias("baseline")).join(
        new.select("metric", F.col("value").alias("improved")), "metric", "full")
    b, i = F.coalesce("baseline", F.lit(0.0)), F.coalesce("improved", F.lit(0.0))
    d = i - b
    return j.select("metric", b.alias("baseline"), i.alias("improved"), d.alias("delta"),
                    F.when(d > tol, fixed.DELTA_ARROWS[0]).when(d < -tol, fixed.DELTA_ARROWS[1]).otherwise(fixed.DELTA_ARROWS[2]).alias("arrow"))


def metrics_long(m: DataFrame, cols=("accuracy", "precision", "recall", "f1")) -> DataFrame:
    """Wide one-row metrics -> (metric, value) rows."""
    parts = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cols)
    return m.selectExpr(f"stack({len(cols)}, {parts}) as (metric, value)")
