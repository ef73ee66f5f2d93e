"""Registered evaluation and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadscope.functions import fixed
from loadscope.operators import metrics, split
from loadscope.plans.q_features import r6
from loadscope.plans.registry import register
from loadscope.sources import views

SEED = 42


def _scored(spark, sf):
    return views.scored(spark, sf)


_CM = """
SELECT CAST(sum(CASE WHEN y = 0 AND p < {t} THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       CAST(sum(CASE WHEN y = 0 AND p >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN y = 1 AND p < {t} THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(sum(CASE WHEN y = 1 AND p >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM v_scored"""


def _m2_sql(src: str, extra: str = "") -> str:
    prec = "coalesce(tp / nullif(tp + fp, 0), 0.0)"
    rec = "coalesce(tp / nullif(tp + fn, 0), 0.0)"
    return f"""SELECT {extra} tn, fp, fn, tp,
  round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0.0), 4) AS accuracy, round({prec}, 4) AS precision,
  round({rec}, 4) AS recall, round(coalesce({prec} * 2.0 * {rec} / nullif({prec} + {rec}, 0), 0.0), 4) AS f1
FROM {src}"""


@register("m1_m2_confusion_metrics", f"WITH cm AS ({_CM.format(t=0.5)}) " + _m2_sql("cm"), views=("v_scored",))
def m1_m2_confusion_metrics(spark, sf):
    s = _scored(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return metrics.binary_metrics(s, "y", "pred")


_TIERS = fixed.RECALL_TIERS + fixed.PRECISION_TIERS
_TIER_SQL = " UNION ALL ".join(
    f"SELECT CAST({t!r} AS DOUBLE) AS threshold, * FROM ({_CM.format(t=t)})" for t in _TIERS)


@register("m6_j7_threshold_tiers", f"""WITH cm AS ({_TIER_SQL}), m AS ({_m2_sql('cm', 'threshold,')})
SELECT *, CAST(tp AS VARCHAR) || '/' || CAST(tp + fn AS VARCHAR) AS caught, fp AS false_alarms FROM m""",
          views=("v_scored",))
def m6_j7_threshold_tiers(spark, sf):
    return metrics.threshold_tiers(_scored(spark, sf))


def _cum_sql(p: str = "p") -> str:
    return f"""sc AS (SELECT {p} AS score, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
                     CAST(sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM v_scored GROUP BY {p}),
c AS (SELECT score, pos, neg,
        CAST(sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
        CAST(sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp,
        CAST(sum(pos) OVER () AS BIGINT) AS P, CAST(sum(neg) OVER () AS BIGINT) AS N FROM sc)"""


@register("m3_m4_ranking_metrics", f"""WITH {_cum_sql()}
SELECT round(coalesce(sum(neg * (tp - pos * 0.5)) / nullif(max(P) * max(N), 0), 0.0), 6) AS roc_auc,
       round(coalesce(sum(pos * coalesce(tp / nullif(tp + fp, 0), 0.0)) / nullif(max(P), 0), 0.0), 6)
         AS average_precision FROM c""", views=("v_scored",))
def m3_m4_ranking_metrics(spark, sf):
    return r6(metrics.ranking_metrics(_scored(spark, sf)))


@register("m5_curve_points", f"""WITH {_cum_sql()}
SELECT score AS threshold, tp, fp, round(coalesce(fp / nullif(N, 0), 0.0), 6) AS fpr,
       round(coalesce(tp / nullif(P, 0), 0.0), 6) AS tpr, round(coalesce(tp / nullif(P, 0), 0.0), 6) AS recall,
       round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision FROM c""", views=("v_scored",))
def m5_curve_points(spark, sf):
    return r6(metrics.curve_points(_scored(spark, sf)))


@register("m8_best_threshold", f"""WITH {_cum_sql()},
pts AS (SELECT score AS threshold, coalesce(tp / nullif(P, 0), 0.0) AS recall,
               coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision FROM c),
f AS (SELECT threshold, recall, precision * 2.0 * recall / (precision + recall + 1e-9) AS f1 FROM pts)
SELECT (SELECT threshold FROM f ORDER BY f1 DESC, threshold ASC LIMIT 1) AS best_threshold,
       round((SELECT max(f1) FROM f), 6) AS best_f1,
       (SELECT max(threshold) FROM f WHERE recall >= 0.8) AS recall_threshold""", views=("v_scored",))
def m8_best_threshold(spark, sf):
    s = _scored(spark, sf)
    b = metrics.best_threshold(s)
    r = metrics.best_threshold(s, metric="recall").select("best_threshold").scalar()
    return b.select("best_threshold", F.round("best_f1", 6).alias("best_f1"), r.alias("recall_threshold"))


@register("m7_class_report", """
WITH g AS (SELECT y, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM v_scored),
k AS (SELECT c AS label,
        coalesce(sum(CASE WHEN y = c AND pred = c THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN pred = c THEN 1 ELSE 0 END), 0), 0.0) AS precision,
        coalesce(sum(CASE WHEN y = c AND pred = c THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN y = c THEN 1 ELSE 0 END), 0), 0.0) AS recall,
        sum(CASE WHEN y = c THEN 1 ELSE 0 END) AS support
      FROM g, (VALUES (0), (1)) v(c) GROUP BY c),
k2 AS (SELECT *, coalesce(precision * 2.0 * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM k),
t AS (SELECT sum(support) AS tot FROM k2)
SELECT CAST(label AS VARCHAR) AS label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
       CAST(support AS BIGINT) AS support FROM k2
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4),
       CAST(sum(support) AS BIGINT) FROM k2
UNION ALL SELECT 'weighted avg', round(sum(precision * support / tot), 4), round(sum(recall * support / tot), 4),
       round(sum(f1 * support / tot), 4), CAST(sum(support) AS BIGINT) FROM k2, t""", views=("v_scored",))
def m7_class_report(spark, sf):
    s = _scored(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return metrics.class_report(s, "y", "pred")


@register("m9_safety_status", f"""WITH cm AS ({_TIER_SQL}), m AS ({_m2_sql('cm', 'threshold,')})
SELECT threshold, recall, CASE WHEN recall >= 0.90 THEN '{fixed.SAFETY_STATUS[0]}'
  WHEN recall >= 0.75 THEN '{fixed.SAFETY_STATUS[1]}' ELSE '{fixed.SAFETY_STATUS[2]}' END AS safety_status FROM m""",
          views=("v_scored",))
def m9_safety_status(spark, sf):
    t = metrics.threshold_table(_scored(spark, sf), _TIERS)
    return t.select("threshold", "recall", metrics.safety_status(F.col("recall")).alias("safety_status"))


def _report_sql(model: str, p: str, t: float) -> str:
    cm = _CM.format(t=t).replace(" p ", f" {p} ").replace("p <", f"{p} <").replace("p >=", f"{p} >=")
    return f"""SELECT '{model}' AS model, CAST({t!r} AS DOUBLE) AS threshold,
  (SELECT round(coalesce(sum(neg * (tp - pos * 0.5)) / nullif(max(P) * max(N), 0), 0.0), 4) FROM c_{p}) AS roc_auc,
  (SELECT round(coalesce(sum(pos * coalesce(tp / nullif(tp + fp, 0), 0.0)) / nullif(max(P), 0), 0.0), 4) FROM c_{p}) AS pr_auc,
  round(coalesce(tp / nullif(tp + fp, 0), 0.0) * 100.0, 2) AS precision_pct,
  round(coalesce(tp / nullif(tp + fn, 0), 0.0) * 100.0, 2) AS recall_pct,
  round(coalesce(coalesce(tp / nullif(tp + fp, 0), 0.0) * 2.0 * coalesce(tp / nullif(tp + fn, 0), 0.0)
        / nullif(coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0), 0), 0.0), 4) AS f1,
  round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0.0) * 100.0, 2) AS accuracy_pct, tp, fp
FROM ({cm})"""


def _cum_named(p: str) -> str:
    return _cum_sql(p).replace("sc AS", f"sc_{p} AS").replace("FROM sc)", f"FROM sc_{p})").replace(
        "c AS (SELECT score", f"c_{p} AS (SELECT score")


_MODELS = [("score_a", "p"), ("score_b", "p2")]


@register("m10_t6_report_rows", "WITH " + _cum_named("p") + ", " + _cum_named("p2") + "\n" + " UNION ALL ".join(
    _report_sql(m, c, t) for m, c in _MODELS for _, t in fixed.OPERATING_MODES), views=("v_scored",))
def m10_t6_report_rows(spark, sf):
    s = _scored(spark, sf)
    out = None
    for m, c in _MODELS:
        r = metrics.report_rows(s, m, [t for _, t in fixed.OPERATING_MODES], "y", c)
        out = r if out is None else out.unionByName(r)
    return out


@register("t4_ranked_report", "WITH " + _cum_named("p") + ", " + _cum_named("p2") + ", rep AS (" + " UNION ALL ".join(
    _report_sql(m, c, t) for m, c in _MODELS for _, t in fixed.OPERATING_MODES) + """)
SELECT *, CAST(row_number() OVER (PARTITION BY threshold ORDER BY f1 DESC, model) AS INTEGER) AS place FROM rep""", views=("v_scored",))
def t4_ranked_report(spark, sf):
    return metrics.ranked_report(m10_t6_report_rows(spark, sf))


@register("j8_compare_metrics", f"""
WITH a AS ({_m2_sql('(' + _CM.format(t=0.5).replace('p <', 'p2 <').replace('p >=', 'p2 >=') + ')')}),
b AS ({_m2_sql('(' + _CM.format(t=0.5) + ')')}),
la AS (SELECT 'accuracy' AS metric, accuracy AS v FROM a UNION ALL SELECT 'precision', precision FROM a
       UNION ALL SELECT 'recall', recall FROM a UNION ALL SELECT 'f1', f1 FROM a),
lb AS (SELECT 'accuracy' AS metric, accuracy AS v FROM b UNION ALL SELECT 'precision', precision FROM b
       UNION ALL SELECT 'recall', recall FROM b UNION ALL SELECT 'f1', f1 FROM b)
SELECT coalesce(la.metric, lb.metric) AS metric, coalesce(la.v, 0.0) AS baseline, coalesce(lb.v, 0.0) AS improved,
       round(coalesce(lb.v, 0.0) - coalesce(la.v, 0.0), 6) AS delta,
       CASE WHEN coalesce(lb.v, 0.0) - coalesce(la.v, 0.0) > 0.001 THEN '{fixed.DELTA_ARROWS[0]}'
            WHEN coalesce(lb.v, 0.0) - coalesce(la.v, 0.0) < -0.001 THEN '{fixed.DELTA_ARROWS[1]}'
            ELSE '{fixed.DELTA_ARROWS[2]}' END AS arrow
FROM la FULL JOIN lb ON la.metric = lb.metric""", views=("v_scored",))
def j8_compare_metrics(spark, sf):
    s = _scored(spark, sf)
    base = metrics.metrics_long(metrics.binary_metrics(s.withColumn("pred", (F.col("p2") >= 0.5).cast("int")), "y", "pred"))
    new = metrics.metrics_long(metrics.binary_metrics(s.withColumn("pred", (F.col("p") >= 0.5).cast("int")), "y", "pred"))
    c = metrics.compare_metrics(base, new)
    return c.withColumn("delta", F.round("delta", 6))


# --------------------------------------------------------------------------- splits
def _quota_sql(src: str, target: str, test_size: float) -> str:
    return f"""cc AS (SELECT {target} AS cls, count(*) AS n FROM {src} GROUP BY 1),
tot AS (SELECT sum(n) AS nn, CAST(ceil(sum(n) * {test_size}) AS BIGINT) AS nt FROM cc),
q0 AS (SELECT cls, (nt * n) // nn AS base, (nt * n) % nn AS rem, nt FROM cc, tot),
q AS (SELECT cls, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, cls) <= max(nt) OVER () - sum(base) OVER ()
                              THEN 1 ELSE 0 END AS quota FROM q0)"""


_R1 = f"""WITH {_quota_sql('v_record', 'injured', 0.2)},
rk AS (SELECT record_id, injured, row_number() OVER (PARTITION BY injured ORDER BY md5('{SEED}|' || CAST(record_id AS VARCHAR)),
              record_id) AS rn FROM v_record)
SELECT record_id, injured, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split
FROM rk JOIN q ON rk.injured = q.cls"""


def _r1(spark, sf):
    t = views.train(spark, sf).select("record_id", "injured")
    return split.stratified_split(t, "injured", "record_id", 0.2, SEED)


@register("r1_stratified_split", _R1, views=("v_record",))
def r1_stratified_split(spark, sf):
    return _r1(spark, sf)


@register("r3_split_report", f"""WITH s AS ({_R1}),
a AS (SELECT split, injured, count(*) AS n FROM s GROUP BY 1, 2 UNION ALL SELECT 'full', injured, count(*) FROM s GROUP BY 2),
t AS (SELECT split, sum(n) AS size FROM a GROUP BY 1),
b AS (SELECT a.split, injured, n, size, n * 100.0 / size AS pct FROM a JOIN t ON a.split = t.split)
SELECT b.split, b.injured, b.n, CAST(b.size AS BIGINT) AS size, round(b.pct, 4) AS pct,
       round(abs(b.pct - f.pct), 4) AS drift_pp FROM b JOIN b f ON f.split = 'full' AND f.injured = b.injured""",
          views=("v_record",))
def r3_split_report(spark, sf):
    return split.split_report(_r1(spark, sf), "injured")


@register("r2_group_split", f"""
WITH g AS (SELECT DISTINCT athlete_id FROM v_record),
rk AS (SELECT athlete_id, row_number() OVER (ORDER BY md5('{SEED}|' || athlete_id), athlete_id) AS rn,
              count(*) OVER () AS gn FROM g)
SELECT r.record_id, r.athlete_id, CASE WHEN rn <= ceil(gn * 0.2) THEN 'test' ELSE 'train' END AS split
FROM v_record r JOIN rk ON r.athlete_id = rk.athlete_id""", views=("v_record",))
def r2_group_split(spark, sf):
    r = views.records(spark, sf).select("record_id", "athlete_id")
    return split.group_split(r, "athlete_id", 0.2, SEED).select("record_id", "athlete_id", "split")


@register("r4_undersample", f"""
WITH np AS (SELECT count(*) AS n FROM v_record WHERE injured = 1),
neg AS (SELECT record_id, injured, row_number() OVER (ORDER BY md5('{SEED}|' || CAST(record_id AS VARCHAR)), record_id) AS rn
        FROM v_record WHERE injured = 0)
SELECT record_id, injured FROM v_record WHERE injured = 1
UNION ALL SELECT record_id, injured FROM neg WHERE rn <= (SELECT CAST(n / 0.5 AS BIGINT) FROM np)""", views=("v_record",))
def r4_undersample(spark, sf):
    t = views.train(spark, sf).select("record_id", "injured")
    return split.undersample(t, "injured", "record_id", 0.5, SEED)


@register("r6_stratified_folds", f"""
SELECT record_id, injured, CAST((row_number() OVER (PARTITION BY injured ORDER BY md5('{SEED}|' || CAST(record_id AS VARCHAR)),
       record_id) - 1) % 5 AS INTEGER) AS fold FROM v_record""", views=("v_record",))
def r6_stratified_folds(spark, sf):
    t = views.train(spark, sf).select("record_id", "injured")
    return split.assign_folds(t, "injured", "record_id", 5, SEED)


@register("r8_class_weights", """
SELECT injured, count(*) AS n, round((SELECT count(*) FROM v_record) / (2.0 * count(*)), 6) AS weight
FROM v_record GROUP BY injured""", views=("v_record",))
def r8_class_weights(spark, sf):
    t = split.class_weights(views.train(spark, sf).select("record_id", "injured"), "injured")
    return t.groupBy("injured").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("weight"), 6).alias("weight"))


@register("r9_pos_weight", """
SELECT CAST(sum(CASE WHEN injured = 0 THEN 1 ELSE 0 END) AS DOUBLE)
       / greatest(sum(CASE WHEN injured = 1 THEN 1 ELSE 0 END), 1) AS scale_pos_weight FROM v_record""",
          views=("v_record",))
def r9_pos_weight(spark, sf):
    t = views.train(spark, sf)
    return t.agg((F.sum(F.when(F.col("injured") == 0, 1).otherwise(0)).cast("double")
                  / F.greatest(F.sum(F.when(F.col("injured") == 1, 1).otherwise(0)), F.lit(1))).alias("scale_pos_weight"))


def _q2_sql(src: str, target: str, test_size: float) -> str:
    return (_quota_sql(src, target, test_size).replace("cc AS", "cc2 AS").replace("FROM cc,", "FROM cc2,")
            .replace("FROM cc)", "FROM cc2)").replace("tot AS", "tot2 AS").replace(", tot)", ", tot2)")
            .replace("q0 AS", "q02 AS").replace("FROM q0)", "FROM q02)").replace("q AS (", "qv AS ("))


_R7 = f"""WITH {_quota_sql('v_record', 'injured', 0.2)},
rk AS (SELECT record_id, injured, row_number() OVER (PARTITION BY injured ORDER BY md5('{SEED}|' || CAST(record_id AS VARCHAR)),
              record_id) AS rn FROM v_record),
s1 AS (SELECT record_id, injured, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM rk JOIN q ON rk.injured = q.cls),
rest AS (SELECT record_id, injured FROM s1 WHERE split = 'train'),
{_q2_sql('rest', 'injured', 0.25)},
rk2 AS (SELECT record_id, injured, row_number() OVER (PARTITION BY injured
               ORDER BY md5('{SEED + 1}|' || CAST(record_id AS VARCHAR)), record_id) AS rn FROM rest)
SELECT record_id, injured, split FROM s1 WHERE split = 'test'
UNION ALL
SELECT record_id, injured, CASE WHEN rn <= quota THEN 'val' ELSE 'train' END FROM rk2 JOIN qv ON rk2.injured = qv.cls"""


@register("r7_three_way_split", _R7, views=("v_record",))
def r7_three_way_split(spark, sf):
    t = views.train(spark, sf).select("record_id", "injured")
    return split.three_way_split(t, "injured", "record_id", 0.2, 0.2, SEED)
