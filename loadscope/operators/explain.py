"""Explanation.

* X1: impurity importances of a tree model -> table (one row per feature), ranked with a
  running cumulative share (W8). The table is bounded by the feature count.
* X2 (re-aimed, TreeSHAP is not built): exact per-row contributions for a linear model,
  ``w_j * (x_j - mean_j)``, computed as column expressions for every row; X2a averages their
  absolute values in one aggregation pass; X2b keeps each row's top-10 by |contribution|.
* Permutation importance for any model: a feature is permuted by joining the row ranked r
  under one hash seed to the row ranked r under another (exact ranks from
  ``split.hash_rank``), the model rescored, and the ROC-AUC drop reported.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadscope.operators import metrics, models, split


def importance_table(spark: SparkSession, model: PipelineModel, names: list[str], top: int | None = None) -> DataFrame:
    """X1 + W8 (+ T2 when ``top``) of a fitted tree model."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return ranked_importances(spark.createDataFrame(list(zip(names, [float(x) for x in imp])), "feature string, importance double"), top)


def ranked_importances(df: DataFrame, top: int | None = None) -> DataFrame:
    """X1 + W8 (+ T2 when ``top``): (feature, importance) rows ranked, with the running share."""
    # The table has one row per feature: an unpartitioned window over it is tiny.
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    out = df.select("feature", "importance", F.row_number().over(w).alias("rank"),
                    F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))
    return out.filter(F.col("rank") <= top) if top else out


def linear_contributions(df: DataFrame, model: PipelineModel, names: list[str], means: dict[str, float],
                         key: str = "id") -> DataFrame:
    """X2b input of a fitted linear model."""
    linear = model.stages[-1]
    return contributions(df, dict(zip(names, linear.coefficients.toArray().tolist())), float(linear.intercept), means, key)


def contributions(df: DataFrame, weights: dict[str, float], intercept: float, means: dict[str, float], key: str = "id") -> DataFrame:
    """X2b input: per row ``contributions array<struct<feature, value>>`` (exact, linear), the base value
    (log odds of a row at the means) and the probability that base and contributions add up to."""
    items = [F.struct(F.lit(n).alias("feature"),
                      ((F.coalesce(F.col(n).cast("double"), F.lit(means.get(n, 0.0))) - F.lit(means.get(n, 0.0)))
                       * F.lit(float(w))).alias("value"))
             for n, w in weights.items()]
    out = df.select(key, F.array(*items).alias("contributions"),
                    F.lit(float(intercept) + sum(w * means.get(n, 0.0) for n, w in weights.items())).alias("base_value"))
    odds = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["value"])
    return out.withColumn("probability", 1 / (1 + F.exp(-odds)))


def top_attributions(contrib: DataFrame, k: int = 10) -> DataFrame:
    """Each row's top-k contributions by absolute impact, with direction text."""
    srt = F.array_sort("contributions", lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                       .when(F.abs(a["value"]) < F.abs(b["value"]), 1)
                       .otherwise(F.when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)))
    top = F.slice(srt, 1, k)
    return contrib.select("*", F.transform(top, lambda x: F.struct(
        x["feature"].alias("feature"), x["value"].alias("value"),
        F.when(x["value"] >= 0, "increases risk").otherwise("decreases risk").alias("direction"))).alias("top"))


def mean_abs_attribution(contrib: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """Mean |contribution| per feature, top-k (one aggregation, then a tiny sort)."""
    aggs = [F.avg(F.abs(F.col("contributions")[i]["value"])).alias(f"a{i}") for i in range(len(names))]
    one = contrib.agg(*aggs)
    parts = ", ".join(f"'{n}', a{i}" for i, n in enumerate(names))
    long = one.selectExpr(f"stack({len(names)}, {parts}) as (feature, mean_abs)")
    return long.orderBy(F.col("mean_abs").desc(), "feature").limit(k)


def permutation_importance(df: DataFrame, model: PipelineModel, cols: list[str], label: str,
                           key: str, seed: int = 7) -> DataFrame:
    """ROC-AUC drop when one feature at a time is permuted across rows."""
    base_scored = models.score_model(df, model, "p", [key, label])
    base = metrics.ranking_metrics(base_scored.withColumnRenamed(label, "y")).first()["roc_auc"]
    a = split.hash_rank(df, key, seed, out="_ra")
    b = split.hash_rank(df.select(key, *cols), key, seed + 1, out="_rb")
    rows = []
    for c in cols:
        donor = b.select(F.col("_rb").alias("_ra"), F.col(c).alias("_perm"))
        permuted = a.join(donor, "_ra").withColumn(c, F.col("_perm")).drop("_perm", "_ra")
        s = models.score_model(permuted, model, "p", [key, label]).withColumnRenamed(label, "y")
        auc = metrics.ranking_metrics(s).first()["roc_auc"]
        rows.append((c, float(base), float(auc), float(base - auc)))
    return df.sparkSession.createDataFrame(rows, "feature string, base_auc double, permuted_auc double, auc_drop double")
