import datetime as dt

import numpy as np
import pytest

from voltcast import constants as C
from voltcast.operators import stats
from voltcast.plans import analytics as an


def _metrics(spark):
    rows = [(C.LINEAR, 37.1, 87.7, 0.996, 0.87), (C.NAIVE, 598.4, 903.0, 0.583, 15.19),
            (C.ENSEMBLE, 55.5, 144.9, 0.989, 1.12), ("Mystery", 60.0, 150.0, 0.98, 1.3)]
    return spark.createDataFrame(rows, "model string, MAE double, RMSE double, R2 double, MAPE double")


def _preds(spark):
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(10):
        t = base + dt.timedelta(minutes=5 * i)
        rows += [(t, "a", 10.0 + i, 10.0 + i + 1), (t, "b", 10.0 + i, 0.0 if i == 3 else 9.0 + i)]
    return spark.createDataFrame(rows, "datetime timestamp_ntz, model string, actual double, predicted double")


def test_status_and_codename(spark):
    m = _metrics(spark)
    st = {r.model: r.status for r in an.model_status(m).collect()}
    assert st == {C.LINEAR: "BEST FIT", C.NAIVE: "BASELINE", C.ENSEMBLE: "ACTIVE", "Mystery": "STANDBY"}
    cn = {r.model: r.codename for r in an.model_codename(m.select("model")).collect()}
    assert cn[C.LINEAR] == "LR_BASELINE_V1" and cn["Mystery"] == "Mystery"


def test_relative_score(spark):
    sc = {r.model: r.score for r in an.relative_score(_metrics(spark)).collect()}
    assert sc[C.LINEAR] == pytest.approx(85.0) and sc[C.NAIVE] == 15.0
    assert sc[C.ENSEMBLE] == pytest.approx(max(15.0, (903.0 - 144.9) / (903.0 - 87.7) * 85))


def test_fallback_on_zero_and_null(spark):
    wide = an.wide_predictions(_preds(spark), ["a", "b"])
    got = {r.datetime.minute: r.shown for r in wide.select("datetime", an.column_fallback("b", "a").alias("shown"))
           .collect()}
    assert got[15] == 14.0 and got[20] == 13.0  # 0 falls through to the fallback column


def test_wide_long_round_trip(spark):
    wide = an.wide_predictions(_preds(spark), ["a", "b"])
    assert set(wide.columns) == {"datetime", "a", "b", "Actual"} and wide.count() == 10
    long = an.long_predictions(wide, ["a", "b"])
    assert long.count() == 30 and {r.series for r in long.select("series").distinct().collect()} == {"Actual", "a", "b"}


def test_metrics_long_and_compare(spark):
    ml = an.metrics_long(_metrics(spark)).filter("is_best = 1").collect()
    assert {(r.metric, r.model) for r in ml} == {("MAE", C.LINEAR), ("RMSE", C.LINEAR), ("MAPE", C.LINEAR)}
    cmp = an.compare_models(_metrics(spark), [C.NAIVE, C.ENSEMBLE]).collect()
    assert len(cmp) == 4 and all(r.best_model == C.ENSEMBLE for r in cmp)


def test_find_model_falls_back_to_best(spark):
    got = {r.requested: r.model for r in an.find_model(_metrics(spark), [C.ENSEMBLE, "Absent"]).collect()}
    assert got == {C.ENSEMBLE: C.ENSEMBLE, "Absent": C.LINEAR}


def test_tail_and_top_zoom(spark):
    p = _preds(spark)
    t = an.tail_per_model(p, 3)
    assert t.count() == 6 and min(r.datetime.minute for r in t.collect()) == 35
    board = stats.leaderboard(stats.regression_metrics(p))
    z = an.top_models_zoom(p, board, 1, 2).collect()
    assert len(z) == 4 and {r.series for r in z} == {"Actual", "a"}


def test_density_2d_and_limits(spark):
    p = _preds(spark)
    d = an.residual_density_2d(p, 4).toPandas()
    assert d.groupby("model")["count"].sum().to_dict() == {"a": 10, "b": 10}
    lim = an.group_limits(p).first()
    absr = np.abs(np.array([1.0] * 19 + [13.0]))
    assert lim.x_min == 0.0 and lim.x_max == 20.0
    assert lim.y_lim == pytest.approx(np.percentile(absr, 98) * 1.15)


def test_resolve_tuned_column(spark):
    cols = ["datetime", "Actual", C.XGB, C.LGBM_TUNED, C.ENSEMBLE]
    assert an.resolve_model_column(cols, C.XGB_TUNED) == C.XGB
    assert an.resolve_model_column(cols, C.LGBM_TUNED) == C.LGBM_TUNED
    assert an.resolve_model_column(cols, C.KNN) is None
    wide = an.wide_predictions(_preds(spark), ["a", "b"]).withColumnRenamed("a", C.XGB)
    got = an.shown_prediction(wide, C.XGB_TUNED, "b").orderBy("datetime").first()
    assert got.shown == 11.0


def test_tied_timestamps_stay_rows_when_the_position_is_a_key(spark):
    from voltcast.plans import analytics as an
    from voltcast.plans import models as M
    rows = [(p, "2024-01-01", m, 10.0 + p, v + p) for p in range(3) for m, v in (("a", 1.0), ("b", 2.0))]
    preds = spark.createDataFrame(rows, "pos int, datetime string, model string, actual double, predicted double")
    wide = an.wide_predictions(preds, ["a", "b"], keys=("datetime", "pos"))
    assert sorted((r.pos, r.a, r.b, r.Actual) for r in wide.collect()) == [(p, 1.0 + p, 2.0 + p, 10.0 + p) for p in range(3)]
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "model string, weight double")
    assert sorted((r.pos, r.predicted) for r in M.blend(preds, weights, "mix", keys=("datetime", "pos")).collect()) == [(p, 1.5 + p) for p in range(3)]


def test_summary_and_histogram_do_not_shuffle_rows_by_model(spark):
    from voltcast.plans import analytics as an
    preds = spark.createDataFrame([("m", float(i), float(i % 7)) for i in range(50)], "model string, actual double, predicted double")
    for df in (an.residual_summary(preds), an.residual_histogram(preds)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan
