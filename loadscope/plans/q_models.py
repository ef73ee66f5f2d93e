"""Registered preprocessing, model and explanation queries.

Training is iterative and has no SQL twin; tests cover it. Every step around it (vote, cascade, ranking,
attribution, alignment, scoring, labels) is also registered over given scores or weights, with a twin.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadscope.functions import fixed
from loadscope.operators import explain, features, grid, metrics, models, prep, split, stages
from loadscope.plans.q_features import MEASURES, r6
from loadscope.plans.registry import register
from loadscope.session import scratch_path, shared_dir
from loadscope.sources import io, views

SEED = 42


# --------------------------------------------------------------------------- C1-C6
_NUM = ["age", "weight_kg", "height_cm", "weekly_volume_hrs", "weekly_intensity_score", "sleep_hours", "hrv_ms",
        "soreness_score", "rest_days", "prior_injuries", "days_since_last_injury"]
_CAT = ["sport", "position"]

_MODE = "(SELECT {c} FROM v_dirty WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@register("c1_c2_impute", "SELECT record_id, " + ", ".join(
    [f"coalesce({c}::DOUBLE, (SELECT quantile_cont({c}, 0.5)::DOUBLE FROM v_dirty)) AS {c}" for c in _NUM]
    + [f"coalesce({c}, {_MODE.format(c=c)}) AS {c}" for c in _CAT]) + " FROM v_dirty", views=("v_dirty",))
def c1_c2_impute(spark, sf):
    d = views.dirty(spark, sf).select("record_id", *[F.col(c).cast("double").alias(c) for c in _NUM], *_CAT)
    params = prep.materialize(prep.fit_impute(d, _NUM).unionByName(prep.fit_modes(d, _CAT)))
    return prep.apply_impute(d, params)


def _onehot_sql() -> str:
    sports = sorted({s for _, s in fixed.SEGMENT_SPORT})[1:]
    positions = sorted({p for _, p in fixed.PRIORITY_POSITION})[1:]
    cols = [f"CASE WHEN sport = '{s}' THEN 1.0 ELSE 0.0 END AS \"sport_{s}\"" for s in sports]
    cols += [f"CASE WHEN position = '{p}' THEN 1.0 ELSE 0.0 END AS \"position_{p}\"" for p in positions]
    return "SELECT record_id, " + ", ".join(cols) + " FROM v_record"


@register("c3_one_hot", _onehot_sql(), views=("v_record",))
def c3_one_hot(spark, sf):
    r = views.records(spark, sf).select("record_id", "sport", "position")
    return prep.apply_one_hot(r, prep.fit_one_hot(r, ["sport", "position"]))


_SC = _NUM


@register("c4_standardise", "SELECT record_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 ELSE stddev_pop({c}) OVER () END, 6) AS {c}"
    for c in _SC) + " FROM v_record", views=("v_record",))
def c4_standardise(spark, sf):
    r = views.records(spark, sf).select("record_id", *_SC)
    return r6(prep.apply_scaler(r, prep.fit_scaler(r, _SC)))


def _c5_sql() -> str:
    from loadscope.plans.q_eval import _quota_sql
    return f"""WITH d AS (SELECT * FROM v_dirty WHERE injured IS NOT NULL),
{_quota_sql('d', 'injured', 0.2)},
rk AS (SELECT d.*, row_number() OVER (PARTITION BY injured ORDER BY md5('{SEED}|' || CAST(record_id AS VARCHAR)),
              record_id) AS rn FROM d),
s AS (SELECT rk.*, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM rk JOIN q ON rk.injured = q.cls),
tr AS (SELECT DISTINCT * EXCLUDE (rn, split) FROM s WHERE split = 'train')
SELECT count(*) AS rows,
       CAST({len(_NUM)} + (SELECT count(DISTINCT sport) - 1 + count(DISTINCT position) - 1 FROM tr) AS INTEGER) AS features,
       CAST(0 AS BIGINT) AS remaining_nulls,
       CAST(sum(CASE WHEN injured = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
       CAST(sum(CASE WHEN injured = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives
FROM s WHERE split = 'test'"""


@register("c5_c6_prep_summary", _c5_sql(), views=("v_dirty",))
def c5_c6_prep_summary(spark, sf):
    d = views.dirty(spark, sf).drop("rhr")
    s = split.stratified_split(d.dropna(subset=["injured"]), "injured", "record_id", 0.2, SEED)
    train = s.filter(F.col("split") == "train").drop("split")
    test = s.filter(F.col("split") == "test").drop("split")
    params = prep.fit_prep(train, _NUM, ["sport", "position"], "injured")
    out = prep.transform_prep(test.drop("athlete_id", "date"), params, "injured")
    return prep.post_summary(out.drop("record_id"), "injured")


# --------------------------------------------------------------------------- model data
FEATURES = ["weekly_total_km", "weekly_high_intensity_km", "mean_perceived_exertion", "mean_perceived_recovery",
            "exertion_recovery_ratio", "acute_chronic_exertion", "workload_spike", "exertion_spike",
            "total_km_d0", "exertion_d0", "recovery_d0"]


def _root(spark, sf) -> str:
    """Where the application keeps what its model queries share."""
    tag = hashlib.md5(sf.encode()).hexdigest()[:12]
    return f"{shared_dir(spark)}/models/{spark.sparkContext.applicationId}/{tag}"


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _once(spark, path: str, make) -> DataFrame:
    """A table that is computed once an application: written whole, then read."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def raw_data(spark, sf) -> DataFrame:
    """Wide lag features (W10 + E3) of all athlete-days with their side of the athlete split (R2)."""
    def make():
        wide = features.load_features(features.to_wide_lags(views.daily_measures(spark, sf), MEASURES, 7))
        d = wide.select(F.concat_ws("|", "athlete_id", F.col("d").cast("string")).alias("id"), "athlete_id",
                        F.col("injury").alias("y"), *FEATURES)
        return split.group_split(_once(spark, f"{_root(spark, sf)}/wide", lambda: d), "athlete_id", 0.2, SEED)
    return _once(spark, f"{_root(spark, sf)}/raw", make)


def model_data(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, imputed and standardised with parameters fitted on the training side only
    (D3, D5). Computed once an application, into the shared folder."""
    raw = raw_data(spark, sf)
    train = raw.filter(F.col("split") == "train").drop("split")
    root = _root(spark, sf)
    if not _exists(spark, f"{root}/preparation"):
        PipelineModel(stages.fit_preparation(train, FEATURES)).write().overwrite().save(f"{root}/preparation")

    def ready(side: str):
        x = vector_to_array(F.col(stages.FEATURES))
        rows = PipelineModel.load(f"{root}/preparation").transform(raw.filter(F.col("split") == side))
        return rows.select("id", "athlete_id", "y", *[x[i].alias(n) for i, n in enumerate(FEATURES)])

    return _once(spark, f"{root}/train", lambda: ready("train")), _once(spark, f"{root}/test", lambda: ready("test"))


def fitted(spark, sf, preset: str, wkind: str) -> PipelineModel:
    """Fitted once an application and kept in the shared folder (S10): the studied system's
    train-then-evaluate artifacts, without pickles."""
    path = f"{_root(spark, sf)}/{preset}-{wkind}"
    if not _exists(spark, f"{path}/metadata/_SUCCESS"):
        train, _ = model_data(spark, sf)
        models.fit_model(models.weighted(train, "y", wkind, "w"), FEATURES, "y", preset, "w", SEED).write().overwrite().save(path)
    return PipelineModel.load(path)


def scored(spark, sf, preset: str, wkind: str) -> DataFrame:
    """(id, y, p) of the test rows by a fitted model: the stored table of scores that evaluations read."""
    def make():
        return models.score_model(model_data(spark, sf)[1], fitted(spark, sf, preset, wkind), "p", ["id", "y"])
    return _once(spark, f"{_root(spark, sf)}/scores-{preset}-{wkind}", make)


def scored_by(spark, sf, fits: list[tuple[str, str]]) -> list[DataFrame]:
    """``scored`` of several (preset, weighting) fits, which train at the same time on the same stored table."""
    model_data(spark, sf)
    with ThreadPoolExecutor(len(fits)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda f: scored(spark, sf, *f)), fits))


_BENCH = [("Logistic Regression", "logistic", "balanced"), ("Random Forest", "forest", "balanced"),
          ("Gradient boosting, depth-wise", "xgboost", "spw"), ("Gradient boosting, leaf-wise", "lightgbm", "spw")]


@register("l1_l3_l11_l12_benchmark")
def l1_l3_l11_l12_benchmark(spark, sf):
    out = None
    for (name, *_), s in zip(_BENCH, scored_by(spark, sf, [b[1:] for b in _BENCH])):
        r = metrics.report_rows(s, name, [t for _, t in fixed.OPERATING_MODES])
        out = r if out is None else out.unionByName(r)
    return out


@register("l6_soft_vote")
def l6_soft_vote(spark, sf):
    votes = None
    for col, s in zip(("rf", "gbm", "lr"), scored_by(spark, sf, [("forest", "balanced"), ("xgboost", "spw"), ("logistic", "balanced")])):
        s = s.withColumnRenamed("p", col)
        votes = s if votes is None else votes.join(s.drop("y"), "id")
    return metrics.threshold_tiers(models.soft_vote(votes, fixed.ENSEMBLE_WEIGHTS, "p"))


_P3 = "CAST((o_orderkey * 17) % 991 AS DOUBLE) / CAST(991 AS DOUBLE)"


def _three_scores(spark, sf) -> DataFrame:
    s = views.scored(spark, sf)
    return s.select("id", "y", F.col("p").alias("rf"), F.col("p2").alias("gbm"), ((F.col("id") * 17 % 991).cast("double") / F.lit(991.0)).alias("lr"))


_VOTE_SQL = f"""SELECT v.id, v.y, round((p * 2.0::DOUBLE + p2 * 2.0::DOUBLE + {_P3} * 1.0::DOUBLE) / 5.0::DOUBLE, 6) AS p_vote
FROM v_scored v JOIN orders o ON o.o_orderkey = v.id"""


@register("l6_vote_of_scores", _VOTE_SQL, views=("v_scored",))
def l6_vote_of_scores(spark, sf):
    """L6 over three given score columns."""
    return r6(models.soft_vote(_three_scores(spark, sf), fixed.ENSEMBLE_WEIGHTS, "p_vote").select("id", "y", "p_vote"))


def _confusion_sql(source: str) -> str:
    ratio = "CASE WHEN {b} = 0 THEN 0.0 ELSE {a}::DOUBLE / {b} END"
    pr, re = ratio.format(a="tp", b="(tp + fp)"), ratio.format(a="tp", b="(tp + fn)")
    return f"""SELECT t1, t2, tn, fp, fn, tp, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 4) AS accuracy, round({pr}, 4) AS precision, round({re}, 4) AS recall,
       round(CASE WHEN ({pr}) + ({re}) = 0 THEN 0.0 ELSE 2.0 * ({pr}) * ({re}) / (({pr}) + ({re})) END, 4) AS f1
FROM (SELECT t1, t2, {", ".join(f"CAST(count(*) FILTER (y = {y} AND predict = {p}) AS BIGINT) AS {n}" for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))}
      FROM {source} GROUP BY t1, t2)"""


_SWEEP = " UNION ALL ".join(f"SELECT {a}::DOUBLE AS t1, {b}::DOUBLE AS t2" for a, b in fixed.CASCADE_CONFIGS)


@register("l7_l8_cascade_of_scores", "WITH t AS (" + _SWEEP + """),
c AS (SELECT t1, t2, y, CASE WHEN p >= t1 AND p2 >= t2 THEN 1 ELSE 0 END AS predict FROM v_scored, t) """ + _confusion_sql("c"), views=("v_scored",))
def l7_l8_cascade_of_scores(spark, sf):
    """L7, L8 over given scores of two stages: the confusion of each pair of thresholds."""
    rows = views.scored(spark, sf).withColumnsRenamed({"p": "p1", "p2": "second"})
    out = None
    for t1, t2 in fixed.CASCADE_CONFIGS:
        c = models.cascade(rows, lambda passed: passed.withColumn("p2", F.col("second")), t1, t2)
        r = metrics.binary_metrics(c, "y", "predict").select(F.lit(t1).alias("t1"), F.lit(t2).alias("t2"), "*")
        out = r if out is None else out.unionByName(r)
    return out


@register("l7_cascade_probability", """SELECT id, round(CASE WHEN p >= 0.15::DOUBLE THEN (p + p2) * 0.5::DOUBLE ELSE p * 0.5::DOUBLE END, 6) AS p_cascade,
CASE WHEN p >= 0.15::DOUBLE AND p2 >= 0.40::DOUBLE THEN 1 ELSE 0 END AS predict FROM v_scored""", views=("v_scored",))
def l7_cascade_probability(spark, sf):
    rows = views.scored(spark, sf).withColumnsRenamed({"p": "p1", "p2": "second"})
    return r6(models.cascade(rows, lambda passed: passed.withColumn("p2", F.col("second"))).select("id", "p_cascade", "predict"))


@register("l7_l8_cascade_sweep")
def l7_l8_cascade_sweep(spark, sf):
    train, test = model_data(spark, sf)
    m1 = fitted(spark, sf, "xgboost", "spw")  # stage 1 does not depend on (t1, t2)
    out = None
    for t1, t2 in fixed.CASCADE_CONFIGS:
        m2 = models.fit_stage2(train, m1, FEATURES, "y", t1, SEED)
        c = models.apply_cascade(test, m1, m2, t1, t2)
        r = metrics.binary_metrics(c, "y", "predict").select(F.lit(t1).alias("t1"), F.lit(t2).alias("t2"), "*")
        out = r if out is None else out.unionByName(r)
    return out


@register("l9_l10_cross_validation")
def l9_l10_cross_validation(spark, sf):
    """All 144 combinations; the best one is refitted on all training rows and saved."""
    train, _ = model_data(spark, sf)
    found = _once(spark, f"{_root(spark, sf)}/grid", lambda: grid.grid_search(train, FEATURES, "y", "id", seed=SEED))
    best = found.where("rank = 1").first().asDict()
    grid.refit(train, FEATURES, "y", best, SEED).write().overwrite().save(f"{_root(spark, sf)}/grid-best")
    return found


@register("l10_fold_metrics")
def l10_fold_metrics(spark, sf):
    """L10 by D4: preparation and SMOTE inside each training fold."""
    train = raw_data(spark, sf).filter(F.col("split") == "train")
    return models.cross_validate(train, FEATURES, "y", "id", "xgboost", seed=SEED)


@register("x1_w8_t2_importances")
def x1_w8_t2_importances(spark, sf):
    m = fitted(spark, sf, "forest", "balanced")
    return explain.importance_table(spark, m, FEATURES, top=10)


_SHARES = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', (SELECT abs(corr({c}::DOUBLE, injured::DOUBLE)) FROM v_record))" for c in _NUM) + ") AS t(feature, c)"


@register("x1_w8_t2_ranked_shares", f"""WITH s AS ({_SHARES}), i AS (SELECT feature, c / sum(c) OVER () AS importance FROM s),
r AS (SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank, sum(importance) OVER (ORDER BY importance DESC, feature) AS cumulative FROM i)
SELECT feature, round(importance, 6) AS importance, CAST(rank AS INTEGER) AS rank, round(cumulative, 6) AS cumulative FROM r WHERE rank <= 10""", views=("v_record",))
def x1_w8_t2_ranked_shares(spark, sf):
    """X1, W8, T2 over shares of correlation with the target."""
    row = views.records(spark, sf).agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col("injured").cast("double"))).alias(c) for c in _NUM])
    long = row.selectExpr("stack(" + str(len(_NUM)) + ", " + ", ".join(f"'{c}', {c}" for c in _NUM) + ") AS (feature, c)")
    shares = long.select("feature", (F.col("c") / F.sum("c").over(Window.partitionBy())).alias("importance"))  # a row a feature
    return r6(explain.ranked_importances(shares, top=10))


def _linear(spark, sf):
    _, te = model_data(spark, sf)
    m = fitted(spark, sf, "logistic", "balanced")
    # Features are standardised on the training side, so the training means are 0.
    return m, explain.linear_contributions(te, m, FEATURES, {}, "id")


@register("x2a_mean_abs_attribution")
def x2a_mean_abs_attribution(spark, sf):
    _, c = _linear(spark, sf)
    return explain.mean_abs_attribution(c, FEATURES, 10)


def _top_rows(c: DataFrame, key: str) -> DataFrame:
    t = explain.top_attributions(c, 10)
    return t.select(key, "base_value", "probability", F.posexplode("top").alias("place", "r")).select(
        key, "base_value", "probability", (F.col("place") + 1).alias("rank"), "r.feature", "r.value", "r.direction")


@register("x2b_top_attributions")
def x2b_top_attributions(spark, sf):
    _, c = _linear(spark, sf)
    return _top_rows(c, "id")


#: Weights of a linear score over the records, by a rule, for the queries that SQL can follow to the end.
_WEIGHTS = {c: (0.01 if i % 2 else -0.01) * (i + 1) for i, c in enumerate(_NUM)}
_INTERCEPT = -0.25


def _given_contributions(spark, sf) -> DataFrame:
    r = views.records(spark, sf)
    means = r.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in _NUM]).first().asDict()
    return explain.contributions(r, _WEIGHTS, _INTERCEPT, means, "record_id")


_PARTS = ("m AS (SELECT " + ", ".join(f"avg({c}::DOUBLE) AS {c}" for c in _NUM) + " FROM v_record),\nv AS ("
          + " UNION ALL ".join(f"SELECT record_id, {i} AS n, '{c}' AS feature, (r.{c}::DOUBLE - m.{c}) * {w!r}::DOUBLE AS value FROM v_record r, m"
                               for i, (c, w) in enumerate(_WEIGHTS.items())) + ")")


@register("x2a_mean_abs_of_given_weights", f"WITH {_PARTS} SELECT feature, round(avg(abs(value)), 6) AS mean_abs FROM v GROUP BY feature ORDER BY avg(abs(value)) DESC, feature LIMIT 10",
          views=("v_record",))
def x2a_mean_abs_of_given_weights(spark, sf):
    return r6(explain.mean_abs_attribution(_given_contributions(spark, sf), _NUM, 10))


@register("x2b_top_of_given_weights", f"""WITH {_PARTS},
b AS (SELECT {_INTERCEPT!r}::DOUBLE + {" + ".join(f"{w!r}::DOUBLE * {c}" for c, w in _WEIGHTS.items())} AS base_value FROM m),
p AS (SELECT record_id, 1 / (1 + exp(-(base_value + total))) AS probability FROM (SELECT record_id, sum(value) AS total FROM v GROUP BY record_id), b),
r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY abs(value) DESC, feature) AS rank FROM v)
SELECT record_id, round(base_value, 6) AS base_value, round(probability, 6) AS probability, CAST(rank AS INTEGER) AS rank, feature, round(value, 6) AS value,
       CASE WHEN value >= 0 THEN 'increases risk' ELSE 'decreases risk' END AS direction FROM r JOIN p USING (record_id), b WHERE rank <= 10""", views=("v_record",))
def x2b_top_of_given_weights(spark, sf):
    # Rounding is most of the work: base value and probability are rounded once a record, before it becomes ten rows.
    return _top_rows(r6(_given_contributions(spark, sf)), "record_id").withColumn("value", F.round("value", 6))


@register("x2_permutation_importance")
def x2_permutation_importance(spark, sf):
    _, te = model_data(spark, sf)
    m = fitted(spark, sf, "logistic", "balanced")
    return explain.permutation_importance(te, m, FEATURES, "y", "id")


def _batch_sql() -> str:
    filled = ", ".join(f"coalesce({c}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM v_dirty)) AS {c}" for c in _NUM)
    scaled = " + ".join(f"{w!r}::DOUBLE * (({c} - (SELECT avg({c}) FROM f)) / (SELECT stddev_pop({c}) FROM f))" for c, w in _WEIGHTS.items())
    return f"""WITH f AS (SELECT record_id, {filled} FROM v_dirty),
p AS (SELECT record_id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({_INTERCEPT!r}::DOUBLE + {scaled}))) AS p FROM f)
SELECT record_id, round(p, 4) AS injury_probability, CASE WHEN p <= 0.30 THEN 'LOW' WHEN p <= 0.60 THEN 'MEDIUM' ELSE 'HIGH' END AS injury_risk_label FROM p"""


@register("l11_f7_batch_scores", _batch_sql(), views=("v_dirty",))
def l11_f7_batch_scores(spark, sf):
    """Preparation fitted on the records, a given linear score and the label, saved as one model, loaded and
    applied. One feature of the model is missing from the table: it is aligned (F7) and weighs nothing here."""
    d = views.dirty(spark, sf)
    names = [*_NUM, "resting_load"]
    prep_stages = stages.fit_preparation(d, names)
    path = scratch_path(spark, "scoring-model")
    PipelineModel([*prep_stages, stages.LinearScore(coefficients=[*_WEIGHTS.values(), 0.5], intercept=_INTERCEPT), stages.RiskLabel()]).write().save(path)
    return PipelineModel.load(path).transform(d).select("record_id", "injury_probability", "injury_risk_label")


@register("l13_s10_train_job")
def l13_s10_train_job(spark, sf):
    """Athlete split, cross-validation with preparation and SMOTE inside the folds, final fit on the
    oversampled training side, model and test split saved, metrics appended to a run-metrics table."""
    root = scratch_path(spark, "l13-run")
    raw = raw_data(spark, sf)
    train, test = (raw.filter(F.col("split") == side).drop("split") for side in ("train", "test"))
    cv = models.cv_summary(models.cross_validate(train, FEATURES, "y", "id", "xgboost", seed=SEED))
    models.fit_scorer(train, FEATURES, "y", "xgboost", resample="smote", seed=SEED).write().save(f"{root}/model")
    test.write.parquet(f"{root}/test_split")
    out = PipelineModel.load(f"{root}/model").transform(spark.read.parquet(f"{root}/test_split")).select("id", "y", F.col("injury_probability").alias("p"))
    rows = metrics.report_rows(out, "xgboost", [t for _, t in fixed.OPERATING_MODES]).crossJoin(F.broadcast(cv))  # one row
    io.append_audit(rows.withColumn("run_path", F.lit(root)), f"{root}/run_metrics")
    return spark.read.parquet(f"{root}/run_metrics")
