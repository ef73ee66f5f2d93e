"""Fit / transform preprocessing with persisted parameter tables.

Fitted state is a small long-form DataFrame ``(step, column_name, category, value)`` —
written with ``io.save_params`` and read back with ``io.load_params`` — never a pickle. Fit
passes are single aggregations; transforms are pure projections (one ``select``), so any
number of columns stays inside one whole-stage-codegen stage.

Order (D3): clean/impute -> features on raw units -> split -> fit encoder/scaler on the
training side only; ids pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.operators import quality
from loadscope.session import scratch_path

PARAMS_SCHEMA = "step string, column_name string, category string, value double"


def _params(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, PARAMS_SCHEMA)


def fit_impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """C1 fit: median per numeric column."""
    med = quality.medians(df, cols)
    parts = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return med.selectExpr(f"stack({len(cols)}, {parts}) as (column_name, value)").select(
        F.lit("median").alias("step"), "column_name", F.lit(None).cast("string").alias("category"), "value")


def fit_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """C2 fit: most frequent value per categorical column, smallest on ties (A10)."""
    m = quality.modes(df, cols)
    return m.select(F.lit("mode").alias("step"), "column_name", F.col("mode").alias("category"),
                    F.lit(None).cast("double").alias("value"))


def fit_one_hot(df: DataFrame, cols: list[str]) -> DataFrame:
    """C3 fit: sorted distinct categories per column, the first one dropped. ``apply_one_hot`` gives a
    column per category, ``one_hot_long`` a row per (id, category) where there are very many."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category")) for c in cols])
    cats = df.select(F.explode(arr).alias("kv")).select("kv.*").filter(F.col("category").isNotNull()).distinct()
    first = cats.groupBy("column_name").agg(F.min("category").alias("_first"))
    kept = cats.join(first, "column_name").filter(F.col("category") != F.col("_first"))
    return kept.select(F.lit("onehot").alias("step"), "column_name", "category", F.lit(None).cast("double").alias("value"))


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """C4 fit: mean and population std (zero std -> 1) per column."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m{i}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}")]
    one = df.agg(*aggs)
    parts = ", ".join(f"'{c}', m{i}, CASE WHEN s{i} = 0 OR s{i} IS NULL THEN 1.0D ELSE s{i} END"
                      for i, c in enumerate(cols))
    long = one.selectExpr(f"stack({len(cols)}, {parts}) as (column_name, mean, std)")
    return long.select(F.explode(F.array(
        F.struct(F.lit("mean").alias("step"), "column_name", F.col("mean").alias("value")),
        F.struct(F.lit("std").alias("step"), "column_name", F.col("std").alias("value")))).alias("r")) \
        .select("r.step", "r.column_name", F.lit(None).cast("string").alias("category"), "r.value")


def _collect(params: DataFrame, step: str) -> list:
    """Parameter tables are one row per column (or category): bounded, safe to read back."""
    return params.filter(F.col("step") == step).select("column_name", "category", "value").collect()


def apply_impute(df: DataFrame, params: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C1/C2 transform: NULL -> stored median / mode. A listed column without a stored
    value is filled with 0.0 (the studied system's unknown-column rule)."""
    med = {r["column_name"]: r["value"] for r in _collect(params, "median")}
    mode = {r["column_name"]: r["category"] for r in _collect(params, "mode")}
    targets = set(cols or []) | set(med) | set(mode)
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in med:
            out.append(F.coalesce(F.col(c), F.lit(med[c]).cast(f.dataType)).alias(c))
        elif c in mode:
            out.append(F.coalesce(F.col(c), F.lit(mode[c]).cast(f.dataType)).alias(c))
        elif c in targets:
            out.append(F.coalesce(F.col(c), F.lit(0.0).cast(f.dataType)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def apply_one_hot(df: DataFrame, params: DataFrame) -> DataFrame:
    """C3 transform: ``<col>_<value>`` 1.0/0.0 columns (unknown -> all zeros), originals dropped."""
    rows = _collect(params, "onehot")
    by_col: dict[str, list[str]] = {}
    for r in rows:
        by_col.setdefault(r["column_name"], []).append(r["category"])
    new = []
    for c in sorted(by_col):
        for v in sorted(by_col[c]):
            new.append(F.when(F.col(c).cast("string") == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{v}"))
    keep = [F.col(c) for c in df.columns if c not in by_col]
    return df.select(*keep, *new)


def one_hot_long(df: DataFrame, params: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """C3 transform in long form: (key, feature) of every indicator that is 1; any number of categories,
    by a join with the fitted table."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category")) for c in cols])
    rows = df.select(key, F.explode(arr).alias("kv")).select(key, "kv.*")
    kept = params.filter(F.col("step") == "onehot").select("column_name", "category")
    return rows.join(kept, ["column_name", "category"]).select(key, F.concat_ws("_", "column_name", "category").alias("feature"))


def apply_scaler(df: DataFrame, params: DataFrame) -> DataFrame:
    """C4 transform: (x - mean) / std."""
    mean = {r["column_name"]: r["value"] for r in _collect(params, "mean")}
    std = {r["column_name"]: r["value"] for r in _collect(params, "std")}
    return df.select(*[((F.col(c).cast("double") - F.lit(mean[c])) / F.lit(std[c])).alias(c) if c in mean else F.col(c)
                       for c in df.columns])


def materialize(params: DataFrame) -> DataFrame:
    """Compute a parameter table once (it is one row per column or category) so later
    transforms do not re-run the fitting aggregations."""
    return params.sparkSession.createDataFrame(params.collect(), PARAMS_SCHEMA)


def fit_prep(df: DataFrame, numeric: list[str], categorical: list[str], target: str) -> DataFrame:
    """C5 fit: dedup -> medians/modes -> (after impute) one-hot categories -> scaler over the
    numeric features (target and ids excluded). Returns one params table."""
    # Every fitting pass reads the cleaned rows: they are computed once, into the shared folder.
    path = scratch_path(df.sparkSession, "prep-fit")
    quality.dedup(quality.drop_null_target(df, target)).write.parquet(path)
    d = df.sparkSession.read.parquet(path)
    p_imp = materialize(fit_impute(d, numeric).unionByName(fit_modes(d, categorical)))
    imputed = apply_impute(d, p_imp)
    return materialize(p_imp.unionByName(fit_one_hot(imputed, categorical)).unionByName(fit_scaler(imputed, numeric)))


def transform_prep(df: DataFrame, params: DataFrame, target: str | None = None) -> DataFrame:
    """C5 transform with stored parameters; target cast to int."""
    out = apply_scaler(apply_one_hot(apply_impute(df, params), params), params)
    if target and target in out.columns:
        out = out.withColumn(target, F.col(target).cast("int"))
    return out


def post_summary(df: DataFrame, target: str) -> DataFrame:
    """Rows, feature count, remaining null cells and target distribution, one row."""
    feats = [c for c in df.columns if c != target]
    nulls = sum((F.col(c).isNull().cast("int") for c in feats[1:]), F.col(feats[0]).isNull().cast("int"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(feats)).alias("features"),
                  F.sum(nulls).cast("bigint").alias("remaining_nulls"),
                  F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).cast("bigint").alias("positives"),
                  F.sum(F.when(F.col(target) == 0, 1).otherwise(0)).cast("bigint").alias("negatives"))
