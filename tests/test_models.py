import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltcast import constants as C
from voltcast.operators.cv import expanding_folds, fold_bounds
from voltcast.operators.knn import knn_regress
from voltcast.plans import models as M
from voltcast.plans import sinks
from voltcast.session import scratch_path

# FIXED VALUES: published test-set RMSE of the two tuned boosters and the stored blend weights
RMSE_LGBM_TUNED = 131.433
RMSE_XGB_TUNED = 173.562
W_XGB, W_LGBM = 0.4309, 0.5691


def test_inverse_rmse_weights_reproduce_published(spark):
    board = spark.createDataFrame([(C.XGB_TUNED, RMSE_XGB_TUNED), (C.LGBM_TUNED, RMSE_LGBM_TUNED), ("KNN", 372.2)],
                                  "model string, RMSE double")
    w = {r.model: r.weight for r in M.inverse_rmse_weights(board, [C.XGB_TUNED, C.LGBM_TUNED]).collect()}
    assert round(w[C.XGB_TUNED], 4) == W_XGB and round(w[C.LGBM_TUNED], 4) == W_LGBM


def test_blend(spark):
    preds = spark.createDataFrame([("t", "a", 10.0, 8.0), ("t", "b", 10.0, 12.0)],
                                  "datetime string, model string, actual double, predicted double")
    w = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "model string, weight double")
    r = M.blend(preds, w, "E").first()
    assert r.predicted == pytest.approx(0.25 * 8 + 0.75 * 12) and r.actual == 10.0


def test_scalers_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    st = M.fit_standard(df, ["a", "c"]).apply(df).collect()
    assert [r.a for r in st] == [-1.0, 1.0] and [r.c for r in st] == [0.0, 0.0]
    mm = M.fit_minmax(df, ["a", "c"]).apply(df).collect()
    assert [r.a for r in mm] == [0.0, 1.0] and [r.c for r in mm] == [0.0, 0.0]


def test_linear_regression_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(100, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1]
    df = spark.createDataFrame([(float(a), float(b), float(c), "t") for (a, b), c in zip(x, y)],
                               "a double, b double, load double, datetime string")
    _, p = M.fit_predict(M.linear_regression(["a", "b"]), df, df, "lr")
    got = np.array([r.predicted for r in p.collect()])
    np.testing.assert_allclose(np.sort(got), np.sort(y), atol=1e-8)


def _brute_knn(tr, yt, te, k):
    out = []
    for q in te:
        d = np.sqrt(((tr - q) ** 2).sum(1))
        idx = np.lexsort((np.arange(len(d)), d))[:k]
        dd, yy = d[idx], yt[idx]
        out.append(yy[dd == 0].mean() if (dd == 0).any() else (yy / dd).sum() / (1 / dd).sum())
    return np.array(out)


def test_knn_matches_brute_force_with_exact_neighbour(spark):
    rng = np.random.default_rng(5)
    tr = rng.normal(size=(300, 3)).round(2)
    yt = rng.normal(size=300)
    te = rng.normal(size=(40, 3)).round(2)
    te[0] = tr[17]  # an exact neighbour: distance 0
    train = spark.createDataFrame([(i, *map(float, r), float(y)) for i, (r, y) in enumerate(zip(tr, yt))],
                                  "o long, a double, b double, c double, y double")
    test = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(te)], "q long, a double, b double, c double")
    got = knn_regress(train, test, ["a", "b", "c"], "y", "o", "q", k=10, train_block=64, test_block=16, chunk=8)
    got = got.orderBy("q").toPandas()
    np.testing.assert_allclose(got["predicted"].to_numpy(), _brute_knn(tr, yt, te, 10), rtol=1e-9)
    assert got.loc[0, "n_exact"] >= 1 and got.loc[0, "predicted"] == pytest.approx(yt[17])


def test_expanding_folds_match_definition(spark):
    n, k = 47, 5
    df = spark.range(n).withColumnRenamed("id", "row")
    f = expanding_folds(df, k).toPandas()
    for fold, start, end in fold_bounds(n, k):
        g = f[f.fold == fold]
        assert sorted(g[g.role == "test"].row) == list(range(start, end))
        assert sorted(g[g.role == "train"].row) == list(range(0, start))


def test_tree_model_beats_naive_and_is_reproducible(spark):
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        season = 100 + 30 * np.sin(2 * np.pi * (i % 24) / 24)
        rows.append((base + dt.timedelta(hours=i), float(season + (i % 5)), float(i % 24), float(season)))
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, load double, h double, lag_24 double")
    train, test = df.filter(F.col("datetime") < base + dt.timedelta(hours=480)), \
        df.filter(F.col("datetime") >= base + dt.timedelta(hours=480))
    m1, p1 = M.fit_predict(M.decision_tree(["h", "lag_24"]), train, test, C.TREE)
    m2, p2 = M.fit_predict(M.decision_tree(["h", "lag_24"]), train, test, C.TREE)
    from voltcast.operators.stats import regression_metrics
    mae_tree = regression_metrics(p1).first().MAE
    naive = test.select("datetime", F.lit("n").alias("model"), F.col("load").alias("actual"),
                        F.col("lag_24").alias("predicted"))
    assert mae_tree <= regression_metrics(naive).first().MAE
    assert sorted(r.predicted for r in p1.collect()) == sorted(r.predicted for r in p2.collect())
    imp = m1.stages[-1].featureImportances.toArray()
    assert imp.sum() == pytest.approx(1.0)


def test_model_save_load_round_trip(spark):
    df = spark.createDataFrame([(float(i), float(2 * i + 1), "t") for i in range(20)],
                               "a double, load double, datetime string")
    model, p = M.fit_predict(M.linear_regression(["a"]), df, df, "lr")
    path = scratch_path(spark, "model")
    sinks.save_model(model, path)
    again = sinks.score(sinks.load_model(path), df, "lr")
    assert sorted(r.predicted for r in again.collect()) == pytest.approx(sorted(r.predicted for r in p.collect()))


def test_early_stopping_stops_on_noise(spark):
    from voltcast.operators import boosting
    from voltcast.plans import tuning
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "row long, x double, load double")
    p = tuning.model_params({"n_estimators": 60, "max_depth": 3, "learning_rate": 0.3}, patience=20)
    model = boosting.fit_many(df, [boosting.Spec(("m",), p, (0, 300), (300, 400))], ["x"], "load", "row")[("m",)]
    assert model.best_round + 20 == len(model.errors) - 1 < 60


def test_search_history_and_running_min(spark):
    from voltcast.operators.stats import running_min
    from voltcast.plans import tuning
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=i), float(np.sin(i / 4.0)), float(i % 24)) for i in range(240)]
    df = spark.createDataFrame(rows, "row long, datetime timestamp_ntz, load double, h double")
    hist, best = tuning.search_all(spark, df, ["h"], {"t": "leafwise"}, n_trials=2, k=2, parallelism=2)
    best = best["t"]
    assert {r.n_trials for r in hist.collect()} == {2}
    h = running_min(hist, "mae", "trial").orderBy("trial").toPandas()
    assert len(h) == 2 and (h["running_min"] <= h["mae"]).all()
    assert best.number in (1, 2)


def test_folds_per_series(spark):
    from voltcast.operators.cv import fold_summary, with_test_fold
    sizes = {"a": 47, "b": 12, None: 30, "short": 5}
    rows = [(s, r, base) for s, n in sizes.items() for r, base in enumerate(range(100, 100 + n))]
    df = spark.createDataFrame(rows, "s string, row long, datetime long").repartition(3)
    got = {(r.s, r.fold, r.role): (r.n_rows, r.first_row, r.last_row, r.first_datetime, r.last_datetime) for r in fold_summary(df, 5, series_keys=["s"]).collect()}
    want = {}
    for s, n in sizes.items():
        for fold, start, end in fold_bounds(n, 5) if n > 5 else []:
            want[(s, fold, "test")] = (end - start, start, end - 1, 100 + start, 99 + end)
            want[(s, fold, "train")] = (start, 0, start - 1, 100, 99 + start)
    assert got == want
    assert {r.test_fold for r in with_test_fold(df, 5, series_keys=["s"]).where("s = 'short'").collect()} == {None}


def test_knn_boxes_visit_only_what_can_matter(spark):
    from voltcast.operators import knn as K
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 2)) * 100
    tr = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 2))).round(1)
    tr[:900] = tr[0]                                                     # a third of the rows at one point, which no cut divides
    yt = rng.normal(size=3000)
    te = np.concatenate([(centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 2))).round(1), tr[:3], [[1e4, 1e4]]])
    train = spark.createDataFrame([(i, *map(float, r), float(y)) for i, (r, y) in enumerate(zip(tr, yt))], "o long, a double, b double, y double").repartition(4)
    test = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(te)], "q long, a double, b double").repartition(3)
    got = K.knn_regress(train, test, ["a", "b"], "y", "o", "q", k=7, train_block=100, test_block=50, chunk=16).orderBy("q").toPandas()
    np.testing.assert_allclose(got["predicted"].to_numpy(), _brute_knn(tr, yt, te, 7), rtol=1e-9)
    vectors = train.select(F.array("a", "b").alias("x"))
    boxes = K.build_boxes(vectors, 2, 100)
    assert boxes.count.sum() == 3000 and boxes.count.max() >= 900 and (boxes.count > 0).sum() > 15
    d = np.sqrt(((te[:, None] - tr[None]) ** 2).sum(2))
    bounded = spark.createDataFrame([(list(map(float, r)), i, float(np.sort(d[i])[6])) for i, r in enumerate(te)], "x array<double>, _key long, bound double")
    copies = K._visits(bounded, boxes, 7, True, 10**6).count() + K._visits(bounded, boxes, 7, False, 10**6).count()
    assert copies < 4 * len(te) < len(te) * (boxes.count > 0).sum() / 3     # neighbouring boxes, not all
    few = train.where("o >= 2996")
    assert K.knn_regress(few, test, ["a", "b"], "y", "o", "q", k=7).count() == len(te)
    assert K.knn_regress(train.where("false"), test, ["a", "b"], "y", "o", "q", k=7).count() == 0
