from pyspark.sql import functions as F

from loadscope.operators import prep


def test_median_and_stored_median(spark):
    df = spark.createDataFrame([(25.0,), (None,), (30.0,), (22.0,)], "age double")
    p = prep.fit_impute(df, ["age"])
    assert p.first().value == 25.0
    stored = spark.createDataFrame([("median", "age", None, 28.0)], prep.PARAMS_SCHEMA)
    new = spark.createDataFrame([(None,), (35.0,)], "age double")
    assert [r.age for r in prep.apply_impute(new, stored).collect()] == [28.0, 35.0]


def test_mode(spark):
    df = spark.createDataFrame([("Football",), (None,), ("Football",), ("Basketball",)], "sport string")
    assert prep.fit_modes(df, ["sport"]).first().category == "Football"


def test_one_hot_drop_first(spark):
    df = spark.createDataFrame([("Football", 0), ("Basketball", 1), ("Football", 0)], "sport string, target int")
    out = prep.apply_one_hot(df, prep.fit_one_hot(df, ["sport"]))
    assert out.columns == ["target", "sport_Football"]
    assert [r.sport_Football for r in out.collect()] == [1.0, 0.0, 1.0]


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(20.0, 0), (30.0, 1), (40.0, 0)], "age double, target int")
    out = prep.apply_scaler(df, prep.fit_scaler(df, ["age"]))
    vals = [r.age for r in out.collect()]
    assert abs(sum(vals)) < 1e-9
    assert abs((sum(v * v for v in vals) / 3) ** 0.5 - 1.0) < 1e-9
    assert [r.target for r in out.collect()] == [0, 1, 0]


def test_fit_then_transform(spark):
    raw = spark.createDataFrame([(25.0, 70.0, "Football", 0), (None, 80.0, None, 1), (30.0, None, "Basketball", 0),
                                 (22.0, 65.0, "Football", 1), (25.0, 70.0, "Football", 0)],
                                "age double, weight double, sport string, target int")
    params = prep.fit_prep(raw, ["age", "weight"], ["sport"], "target")
    from loadscope.operators import quality
    out = prep.transform_prep(quality.dedup(raw), params, "target")
    assert out.count() == 4
    assert out.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in out.columns]).first().asDict() == \
        {c: 0 for c in out.columns}
    new = spark.createDataFrame([(24.0, 75.0, "Football", 0)], "age double, weight double, sport string, target int")
    assert prep.transform_prep(new, params, "target").count() == 1
