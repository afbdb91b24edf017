import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltcast.operators import stats


def _preds(spark, rows):
    return spark.createDataFrame(rows, "datetime string, model string, actual double, predicted double")


def test_metrics_zero_actual_and_r2(spark):
    rows = [("t1", "m", 0.0, 1.0), ("t2", "m", 10.0, 8.0), ("t3", "m", 20.0, 25.0)]
    r = stats.regression_metrics(_preds(spark, rows)).first()
    y, p = np.array([0, 10, 20.0]), np.array([1, 8, 25.0])
    assert r.MAE == pytest.approx(np.mean(np.abs(y - p)))
    assert r.RMSE == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert r.R2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    assert r.MAPE == pytest.approx(np.mean([0.2, 0.25]) * 100) and r.n_zero_actual == 1


def test_r2_constant_actual(spark):
    perfect = _preds(spark, [("a", "m", 5.0, 5.0), ("b", "m", 5.0, 5.0)])
    off = _preds(spark, [("a", "m", 5.0, 4.0), ("b", "m", 5.0, 6.0)])
    assert stats.regression_metrics(perfect).first().R2 == 1.0
    assert stats.regression_metrics(off).first().R2 == 0.0


def test_histogram_edges_and_flat(spark):
    vals = [0.0, 1.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = stats.equal_width_histogram(df, "x", 5).orderBy("bin").toPandas()
    want, _ = np.histogram(vals, bins=5)
    assert h["count"].tolist() == want.tolist() and h["center"].iloc[0] == pytest.approx(1.0)
    flat = spark.createDataFrame([(2.0,)] * 4, "x double")
    hf = stats.equal_width_histogram(flat, "x", 3).orderBy("bin").toPandas()
    assert hf["count"].tolist() == [4, 0, 0]


def test_exact_percentile_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(size=3000).round(3)
    df = spark.createDataFrame([(float(v),) for v in vals], "a double")
    for q in (0.5, 0.98, 0.0, 1.0):
        want = np.percentile(vals, q * 100)
        assert stats.exact_percentile(df, "a", q, accuracy=200) == pytest.approx(want)
        assert stats.exact_percentile(df, "a", q) == pytest.approx(want)


def test_correlation_long_lower_triangle(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "c"])
    df = spark.createDataFrame(pdf)
    got = stats.correlation_long(df, ["a", "b", "c"]).toPandas()
    assert len(got) == 6
    c = pdf.corr()
    for r in got.itertuples():
        assert r.corr == pytest.approx(c.loc[r.feature_a, r.feature_b])


def test_running_min_and_best(spark):
    maes = [42.9, 43.1, 41.0, 41.5, 40.2, 40.2]
    df = spark.createDataFrame([(i + 1, m) for i, m in enumerate(maes)], "trial int, mae double")
    rm = stats.running_min(df, "mae", "trial").orderBy("trial").toPandas()["running_min"].tolist()
    assert rm == pd.Series(maes).cummin().tolist()
    b = stats.best_of_history(df, "mae", "trial").first()
    assert b.best_trial == 5 and b.best_mae == 40.2


def test_residual_summary(spark):
    rows = [(str(i), "m", float(i), 0.0) for i in range(10)] + [("x", "m", 100.0, 0.0)]
    r = stats.residual_summary(_preds(spark, rows)).first()
    res = np.array([float(i) for i in range(10)] + [100.0])
    assert r.mean_residual == pytest.approx(res.mean()) and r.var_residual == pytest.approx(res.var())
    want = np.mean(np.abs(res - res.mean()) > 2.5 * res.std()) * 100
    assert r.outlier_pct == pytest.approx(want)


def test_flat_residuals_do_not_fail(spark):
    from voltcast.plans import analytics as an
    rows = [(str(i), "m", 5.0, 3.0) for i in range(6)]
    p = _preds(spark, rows)
    h = an.residual_histogram(p, 15).orderBy("bin").toPandas()
    assert h["count"].tolist()[0] == 6 and h["count"].sum() == 6
    k = an.residual_kde(p, 10).toPandas()
    assert len(k) == 10 and k["density"].isna().all()
