import pytest
from pyspark.sql import functions as F

from tagloom.functions.patterns import pattern, series
from tagloom.operators.models import failure_probability, train_failure_model, train_linear


def test_patterns(spark):
    s = {k: [r.value for r in series(spark, k, 4000, 3).orderBy("id").collect()] for k in ("uniform", "gaussian", "constant", "gradient", "sinusoid", "repeating", "bimodal", "exponential")}
    mean = lambda v: sum(v) / len(v)
    assert abs(mean(s["uniform"]) - 0.5) < 0.02 and abs(mean(s["gaussian"])) < 0.06 and abs(mean(s["exponential"]) - 1) < 0.06
    assert set(s["constant"]) == {1.0} and s["gradient"][-1] == 1.0 and s["repeating"][:16] == s["repeating"][16:32]
    assert all(abs(abs(v) - 1) < 0.6 for v in s["bimodal"]) and max(s["sinusoid"]) <= 1
    with pytest.raises(ValueError):
        pattern("none", F.col("id"), 1)


def test_models_on_held_out_rows(spark):
    rows = spark.range(1200).select("id", pattern("uniform", F.col("id"), 1200, 5).alias("a"), pattern("gaussian", F.col("id"), 1200, 9).alias("b"))
    rows = rows.withColumn("b", F.when(F.col("id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("b"))).withColumn("y", (F.col("a") > 0.6).cast("int")).withColumn("z", 3 * F.col("a") + 2)
    train, held = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    p = failure_probability(train_failure_model(train, ["a", "b"], "y", trees=8), held, ["a", "b"])
    assert p.where((F.col("probability") > 0.5).cast("int") == F.col("y")).count() > 0.95 * held.count()
    m = train_linear(train, ["a"], "z")
    assert m.transform(held).where("abs(predicted - z) > 0.001").count() == 0


def test_predictors_fit_save_and_load(spark, tmp_path):
    import numpy as np
    import pytest

    from tagloom.operators.models import DenseNet, Pipelined

    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (600, 2))
    rows = [(int(i), float(a), None if i % 50 == 0 else float(b), float(2 * a - abs(b) + 1), float(a * b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, a double, b double, ratio double, ms double").repartition(3)
    error = lambda got, t: float(np.mean([abs(r[t] - r[f"predicted_{t}"]) for r in got.where("b is not null").collect()]))
    net = DenseNet(["a", "b"], ["ratio", "ms"], (12,))
    assert not net.is_ready()
    with pytest.raises(ValueError):
        net.predict(df)
    net.fit(df, 80, 0.05)
    assert net.is_ready() and error(net.predict(df), "ratio") < 0.2 and net.predict(df).columns == [*df.columns, "predicted_ratio", "predicted_ms"]
    net.save(spark, str(tmp_path / "net"))
    again = DenseNet.load(spark, str(tmp_path / "net"))
    assert sorted(map(tuple, again.predict(df).select("k", "predicted_ms").collect())) == sorted(map(tuple, net.predict(df).select("k", "predicted_ms").collect()))
    trees = Pipelined("trees", ["a", "b"], ["ratio"]).fit(df)
    assert trees.is_ready() and error(trees.predict(df), "ratio") < 0.2
    trees.save(spark, str(tmp_path / "trees"))
    assert abs(error(Pipelined.load(spark, str(tmp_path / "trees"), "trees", ["a", "b"], ["ratio"]).predict(df), "ratio") - error(trees.predict(df), "ratio")) < 1e-9
    assert error(Pipelined("linear", ["a", "b"], ["ratio"]).fit(df).predict(df.where("b is not null")), "ratio") < 0.5
