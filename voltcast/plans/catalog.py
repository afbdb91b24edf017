"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

They read the driver's tables through the adapters, run the library's
operators over the whole input and present doubles rounded to 6 decimals so
results can be compared with the DuckDB oracle.

The feature frames are memoised (and persisted) per session and directory:
a real run builds them once and every later stage reads them, as the
reference does with its in-memory frame.
"""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from voltcast import constants as C
from voltcast.constants import FIVE_MIN, HEATMAP_FEATURES, HOURLY, Cadence
from voltcast.functions.features import drop_incomplete
from voltcast.operators import boosting, stats
from voltcast.operators import cv as cvops
from voltcast.operators.knn import knn_regress
from voltcast.operators.ordered import lookback_sequences, position_index
from voltcast.plans import analytics as an
from voltcast.plans import features as fp
from voltcast.plans import models as M
from voltcast.plans import sinks, tuning
from voltcast.session import scratch_path
from voltcast.sources import adapters, readers

SPLIT = "2024-01-24"  # test data span January 2024; the last week is the test set

_memo: dict = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append((F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def _key(spark: SparkSession, sf_dir: str, *parts) -> tuple:
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), *parts)


def memo(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    k = _key(spark, sf_dir, name)
    if k not in _memo:
        _memo[k] = build().persist()
    return _memo[k]


def clear_memo() -> None:
    for df in _memo.values():
        try:
            df.unpersist()
        except Exception:  # noqa: BLE001 - session may already be gone
            pass
    _memo.clear()
    _fits.clear()
    _fit_locks.clear()


def raw_series(spark: SparkSession, sf_dir: str, cadence: Cadence) -> DataFrame:
    minutes = 5 if cadence is FIVE_MIN else 60
    return adapters.load_series(adapters.table(spark, sf_dir, "events"), minutes)


def engineered(spark: SparkSession, sf_dir: str, cadence: Cadence = FIVE_MIN) -> DataFrame:
    """All rows (pre-drop) with every feature and ``pos``."""
    return memo(spark, sf_dir, f"engineered-{cadence.seasonal}",
                lambda: fp.engineer(raw_series(spark, sf_dir, cadence), cadence, block_size=C.DEFAULT_BLOCK))


def features(spark: SparkSession, sf_dir: str, cadence: Cadence = FIVE_MIN) -> DataFrame:
    """Complete rows only (the model input)."""
    def build():
        df = drop_incomplete(engineered(spark, sf_dir, cadence))
        return df.select("pos", "datetime", "load", *cadence.features)
    return memo(spark, sf_dir, f"features-{cadence.seasonal}", build)


# --------------------------------------------------------------------------- features

def q_position_index(spark, sf_dir):
    ev = adapters.table(spark, sf_dir, "events").select("event_id", "ts")
    return position_index(ev, ["ts", "event_id"]).select("event_id", "pos")


def q_ffill(spark, sf_dir):
    return rounded(engineered(spark, sf_dir).select("datetime", "wdir_filled"))\
        .withColumnRenamed("wdir_filled", "wdir")


def q_feat_lag(spark, sf_dir):
    return rounded(engineered(spark, sf_dir).select("datetime", *FIVE_MIN.lag_names))


def q_feat_rolling(spark, sf_dir):
    return rounded(engineered(spark, sf_dir).select("datetime", *FIVE_MIN.roll_names))


def q_feat_cyclical(spark, sf_dir):
    return rounded(engineered(spark, sf_dir).select("datetime", "hour_sin", "hour_cos", "month_sin", "month_cos"))


def q_feat_wind(spark, sf_dir):
    return rounded(engineered(spark, sf_dir).select("datetime", "wdir_sin", "wdir_cos"))


def q_feat_calendar(spark, sf_dir):
    return engineered(spark, sf_dir).select("datetime", "weekday", "weekend", "is_peak_hour", "is_day")


def q_feat_interaction(spark, sf_dir):
    return rounded(engineered(spark, sf_dir).select("datetime", "temp_hour", "temp_x_peak"))


def q_feature_frame(spark, sf_dir):
    return rounded(features(spark, sf_dir).drop("pos"))


def q_chrono_split(spark, sf_dir):
    return rounded(fp.chrono_split(features(spark, sf_dir), SPLIT).select("datetime", "load", "split"))


def q_drop_incomplete(spark, sf_dir):
    return rounded(drop_incomplete(adapters.hourly_type_pivot(spark, sf_dir)))


def q_ingest_profile(spark, sf_dir):
    raw = raw_series(spark, sf_dir, FIVE_MIN)
    return rounded(raw.agg(F.count(F.lit(1)).alias("n_rows"),
                           F.min("datetime").cast("date").alias("first_date"),
                           F.max("datetime").cast("date").alias("last_date"),
                           F.min("load").alias("min_load"), F.max("load").alias("max_load")))


def q_feature_profile(spark, sf_dir):
    return rounded(stats.feature_profile(features(spark, sf_dir), FIVE_MIN.features))


def q_correlation_long(spark, sf_dir):
    return rounded(stats.correlation_long(features(spark, sf_dir), HEATMAP_FEATURES))


FEATURE_QUERIES = {
    "position_index": q_position_index,
    "ffill": q_ffill,
    "feat_lag": q_feat_lag,
    "feat_rolling": q_feat_rolling,
    "feat_cyclical": q_feat_cyclical,
    "feat_wind": q_feat_wind,
    "feat_calendar": q_feat_calendar,
    "feat_interaction": q_feat_interaction,
    "feature_frame": q_feature_frame,
    "chrono_split": q_chrono_split,
    "drop_incomplete": q_drop_incomplete,
    "ingest_profile": q_ingest_profile,
    "feature_profile": q_feature_profile,
    "correlation_long": q_correlation_long,
}


ALL_QUERIES: dict = {}
ALL_QUERIES.update(FEATURE_QUERIES)


# --------------------------------------------------------------------------- forecasts (SQL-checkable set)


ENSEMBLE_SQL = "Ensemble (Naive+LR)"
LR_COLS = ["lag_12", "roll_mean_12"]
KNN_COLS = ["lag_12", "roll_mean_12"]
SQL_MODELS = [C.NAIVE, C.LINEAR, ENSEMBLE_SQL]


def split_frames(spark, sf_dir, cadence: Cadence = FIVE_MIN):
    ff = features(spark, sf_dir, cadence)
    return fp.train_test(ff, SPLIT)


def base_predictions(spark, sf_dir) -> DataFrame:
    """Naive (seasonal lag) and 2-feature OLS predictions on the test rows."""
    def build():
        train, test = split_frames(spark, sf_dir)
        naive = M.naive_forecast(test, "lag_288")
        _, lr = M.fit_predict(M.linear_regression(LR_COLS), train, test, C.LINEAR)
        return naive.unionByName(lr)
    return memo(spark, sf_dir, "base-preds", build)


def prediction_set(spark, sf_dir) -> DataFrame:
    """Base predictions plus their inverse-RMSE blend (weights from the rounded test board)."""
    def build():
        base = base_predictions(spark, sf_dir)
        board = stats.leaderboard(stats.regression_metrics(base))
        w = M.inverse_rmse_weights(board, [C.NAIVE, C.LINEAR])
        return base.unionByName(M.blend(base, w, ENSEMBLE_SQL))
    return memo(spark, sf_dir, "pred-set", build)


def metrics_set(spark, sf_dir) -> DataFrame:
    return memo(spark, sf_dir, "metrics-set", lambda: stats.regression_metrics(prediction_set(spark, sf_dir)))


def board_set(spark, sf_dir) -> DataFrame:
    return stats.leaderboard(metrics_set(spark, sf_dir))


def q_naive_metrics_hourly(spark, sf_dir):
    """Flagship: hourly series -> features -> split -> seasonal naive (lag 24) -> metrics."""
    train, test = split_frames(spark, sf_dir, HOURLY)
    return rounded(stats.regression_metrics(M.naive_forecast(test, "lag_24")))


def q_naive_forecast(spark, sf_dir):
    return rounded(prediction_set(spark, sf_dir).filter(F.col("model") == C.NAIVE))


def q_linreg_forecast(spark, sf_dir):
    return rounded(prediction_set(spark, sf_dir).filter(F.col("model") == C.LINEAR))


def q_ensemble_forecast(spark, sf_dir):
    return rounded(prediction_set(spark, sf_dir).filter(F.col("model") == ENSEMBLE_SQL))


def q_regression_metrics(spark, sf_dir):
    return rounded(metrics_set(spark, sf_dir))


def q_metrics_union(spark, sf_dir):
    preds = prediction_set(spark, sf_dir)
    parts = [stats.regression_metrics(preds.filter(F.col("model") == m)) for m in SQL_MODELS]
    return rounded(M.union_predictions(parts))


def q_leaderboard(spark, sf_dir):
    return rounded(board_set(spark, sf_dir))


def q_residuals(spark, sf_dir):
    return rounded(an.residuals(prediction_set(spark, sf_dir)))


def q_model_status(spark, sf_dir):
    return an.model_status(metrics_set(spark, sf_dir))


def q_model_codename(spark, sf_dir):
    return an.model_codename(metrics_set(spark, sf_dir).select("model"))


def q_prediction_fallback(spark, sf_dir):
    wide = an.wide_predictions(prediction_set(spark, sf_dir), SQL_MODELS)
    return rounded(an.shown_prediction(wide, C.LINEAR, ENSEMBLE_SQL))


def q_relative_score(spark, sf_dir):
    return rounded(an.relative_score(metrics_set(spark, sf_dir)))


def q_wide_predictions(spark, sf_dir):
    return rounded(an.wide_predictions(prediction_set(spark, sf_dir), SQL_MODELS))


def q_long_predictions(spark, sf_dir):
    wide = an.wide_predictions(prediction_set(spark, sf_dir), SQL_MODELS)
    return rounded(an.long_predictions(wide, SQL_MODELS))


def q_metrics_long(spark, sf_dir):
    return rounded(an.metrics_long(board_set(spark, sf_dir)))


def q_compare_models(spark, sf_dir):
    return rounded(an.compare_models(board_set(spark, sf_dir), SQL_MODELS))


def q_top3_zoom(spark, sf_dir):
    return rounded(an.top_models_zoom(prediction_set(spark, sf_dir), board_set(spark, sf_dir), 3,
                                      FIVE_MIN.rows_per_day))


def q_model_lookup(spark, sf_dir):
    return rounded(an.find_model(board_set(spark, sf_dir), [ENSEMBLE_SQL, C.LGBM_TUNED]))


def q_r2_ranking(spark, sf_dir):
    b = board_set(spark, sf_dir)
    w = F.row_number().over(Window.orderBy("R2", "model"))
    return rounded(b.select("model", "R2", w.alias("r2_rank")))


def q_tail_n(spark, sf_dir):
    return rounded(an.tail_per_model(prediction_set(spark, sf_dir), 2 * FIVE_MIN.rows_per_day))


def q_residual_summary(spark, sf_dir):
    return rounded(an.residual_summary(prediction_set(spark, sf_dir)))


def q_residual_histogram(spark, sf_dir):
    return rounded(an.residual_histogram(prediction_set(spark, sf_dir), 15))


def q_residual_kde(spark, sf_dir):
    return rounded(an.residual_kde(prediction_set(spark, sf_dir), 200))


def q_residual_density_2d(spark, sf_dir):
    return rounded(an.residual_density_2d(prediction_set(spark, sf_dir), 20))


def q_group_limits(spark, sf_dir):
    return rounded(an.group_limits(prediction_set(spark, sf_dir)))


# --------------------------------------------------------------------------- scalers, kNN, sequences

def q_scale_standard(spark, sf_dir):
    train, test = split_frames(spark, sf_dir)
    sc = M.fit_standard(train, FIVE_MIN.features)
    return rounded(sc.apply(test.select("datetime", *FIVE_MIN.features)))


def minmax_frame(spark, sf_dir) -> DataFrame:
    cols = [*FIVE_MIN.features, C.TARGET]
    train, _ = split_frames(spark, sf_dir)
    sc = M.fit_minmax(train, cols)
    return sc.apply(features(spark, sf_dir).select("pos", "datetime", *cols))


def q_scale_minmax(spark, sf_dir):
    return rounded(minmax_frame(spark, sf_dir).drop("pos"))


def q_knn_forecast(spark, sf_dir):
    train, test = split_frames(spark, sf_dir)
    sc = M.fit_standard(train, KNN_COLS)
    tr, te = sc.apply(train), sc.apply(test)
    pred = knn_regress(tr, te, KNN_COLS, C.TARGET, train_order="pos", test_key="datetime", k=10)
    out = te.select("datetime", F.col(C.TARGET).alias("actual")).join(pred, "datetime")
    return rounded(out.select("datetime", F.lit(C.KNN).alias("model"), "actual", "predicted"))


def q_lookback_sequences(spark, sf_dir):
    cols = [*FIVE_MIN.features, C.TARGET]
    scaled = fp.post_drop_position(minmax_frame(spark, sf_dir))
    seq = lookback_sequences(scaled, cols, C.TARGET, 24, pos_col="row", block_size=C.DEFAULT_BLOCK)
    return rounded(seq.select("datetime", "label", F.size("seq").alias("n_values"),
                              F.aggregate("seq", F.lit(0.0), lambda a, x: a + x).alias("seq_sum"),
                              F.col("seq")[0].alias("seq_first"),
                              F.element_at("seq", -1).alias("seq_last")))


# --------------------------------------------------------------------------- time-ordered CV

def ranked_rows(spark, sf_dir) -> DataFrame:
    """The complete rows with their position among themselves."""
    return memo(spark, sf_dir, "post-drop-rows", lambda: fp.post_drop_position(features(spark, sf_dir)))


def q_expanding_folds(spark, sf_dir):
    return cvops.fold_summary(ranked_rows(spark, sf_dir), 5)


def cv_naive_frame(spark, sf_dir) -> DataFrame:
    f = cvops.with_test_fold(ranked_rows(spark, sf_dir), 5).where("test_fold > 0")
    return f.groupBy(F.col("test_fold").alias("fold")).agg(F.count(F.lit(1)).alias("n_test"),
                                                           F.avg(F.abs(F.col(C.TARGET) - F.col("lag_288"))).alias("mae"))


def q_cv_naive(spark, sf_dir):
    return rounded(cv_naive_frame(spark, sf_dir))


def q_cv_summary(spark, sf_dir):
    return rounded(stats.cv_summary(cv_naive_frame(spark, sf_dir), "mae"))


def q_running_min(spark, sf_dir):
    return rounded(stats.running_min(cv_naive_frame(spark, sf_dir), "mae", "fold"))


def q_best_of_history(spark, sf_dir):
    return rounded(stats.best_of_history(cv_naive_frame(spark, sf_dir), "mae", "fold"))


ANALYTIC_QUERIES = {
    "naive_forecast": q_naive_forecast,
    "linreg_forecast": q_linreg_forecast,
    "ensemble_forecast": q_ensemble_forecast,
    "regression_metrics": q_regression_metrics,
    "metrics_union": q_metrics_union,
    "leaderboard": q_leaderboard,
    "residuals": q_residuals,
    "model_status": q_model_status,
    "model_codename": q_model_codename,
    "prediction_fallback": q_prediction_fallback,
    "relative_score": q_relative_score,
    "wide_predictions": q_wide_predictions,
    "long_predictions": q_long_predictions,
    "metrics_long": q_metrics_long,
    "compare_models": q_compare_models,
    "top3_zoom": q_top3_zoom,
    "model_lookup": q_model_lookup,
    "r2_ranking": q_r2_ranking,
    "tail_n": q_tail_n,
    "residual_summary": q_residual_summary,
    "residual_histogram": q_residual_histogram,
    "residual_kde": q_residual_kde,
    "residual_density_2d": q_residual_density_2d,
    "group_limits": q_group_limits,
    "scale_standard": q_scale_standard,
    "scale_minmax": q_scale_minmax,
    "knn_forecast": q_knn_forecast,
    "lookback_sequences": q_lookback_sequences,
    "expanding_folds": q_expanding_folds,
    "cv_naive": q_cv_naive,
    "cv_summary": q_cv_summary,
    "running_min": q_running_min,
    "best_of_history": q_best_of_history,
}
ALL_QUERIES.update(ANALYTIC_QUERIES)


# --------------------------------------------------------------------------- sources and sinks


def q_ingest_csv(spark, sf_dir):
    """Derived raw table -> reference CSV layout (padded headers, index, extra column) -> ingest repairs."""
    path = scratch_path(spark, "raw-load-csv")
    readers.write_raw_csv(raw_series(spark, sf_dir, FIVE_MIN), path)
    return rounded(readers.read_load_csv(spark, ["/nonexistent/raw.csv", path]))


def q_artefact_metrics(spark, sf_dir):
    """Board -> stored metrics CSV (display names) -> declared-schema reader."""
    path = scratch_path(spark, "model-metrics")
    sinks.write_metrics(board_set(spark, sf_dir), path)
    return rounded(readers.read_metrics(spark, path))


def forecast_config(spark, sf_dir) -> DataFrame:
    """Blend weights and best model as one row (the configuration document)."""
    board = board_set(spark, sf_dir)
    w = M.inverse_rmse_weights(board, [C.NAIVE, C.LINEAR])
    pick = {C.NAIVE: "w_naive", C.LINEAR: "w_lr"}
    cols = [F.first(F.when(F.col("model") == m, F.col("weight")), ignorenulls=True).alias(k) for m, k in pick.items()]
    return w.agg(*cols).withColumn("best_model", an.best_value(board, "model"))


def q_forecast_config(spark, sf_dir):
    return rounded(forecast_config(spark, sf_dir))


def q_config_defaults(spark, sf_dir):
    """Written config read back; absent fields take the 50/50 defaults."""
    path = scratch_path(spark, "forecast-config")
    sinks.write_config(forecast_config(spark, sf_dir), path)
    cfg = readers.read_config(spark, path, {"w_naive": 0.5, "w_lr": 0.5, "w_xgb": 0.5, "w_lgbm": 0.5})
    return rounded(cfg.select("w_naive", "w_lr", "w_xgb", "w_lgbm", "best_model"))


ALL_QUERIES.update({
    "ingest_csv": q_ingest_csv,
    "artefact_metrics": q_artefact_metrics,
    "forecast_config": q_forecast_config,
    "config_defaults": q_config_defaults,
})


# --------------------------------------------------------------------------- reference forecasters (rows checks)


FEATS = FIVE_MIN.features
N_TRIALS = 50  # per study
_fit_locks: dict = {}
_fits: dict = {}


def fit_once(spark, sf_dir, name: str, build):
    """A fitted result, built once per application and input; only callers of the same one wait for it."""
    key = _key(spark, sf_dir, name)
    with _fit_locks.setdefault(key, threading.Lock()):
        if key not in _fits:
            _fits[key] = build()
        return _fits[key]


PIPELINES = {C.TREE: M.decision_tree}
TREE_MODELS = [C.TREE, C.FOREST]
BOOSTED = {C.GBT: M.GRADIENT, C.XGB: M.REGULARISED, C.LGBM: M.LEAF_WISE}


def fitted(spark, sf_dir, names) -> dict:
    """The named reference forecasters, fitted concurrently; the boosted ones are grown together."""
    train, test = split_frames(spark, sf_dir)

    def one(name):
        if name in BOOSTED:
            return fit_once(spark, sf_dir, "boosted", lambda: M.fit_boosted(BOOSTED, train, test, FEATS))[name]
        if name == C.FOREST:
            return fit_once(spark, sf_dir, name, lambda: M.fit_forest(name, M.BAGGED, train, test, FEATS))
        return fit_once(spark, sf_dir, name, lambda: M.fit_all({name: PIPELINES[name](FEATS)}, train, test)[name])

    with ThreadPoolExecutor(max_workers=len(names)) as ex:
        return dict(zip(names, ex.map(one, names)))


def _preds(spark, sf_dir, name):
    return rounded(fitted(spark, sf_dir, [name])[name].predictions)


def q_tree_forecast(spark, sf_dir):
    return _preds(spark, sf_dir, C.TREE)


def q_forest_forecast(spark, sf_dir):
    return _preds(spark, sf_dir, C.FOREST)


def q_gbt_forecast(spark, sf_dir):
    return _preds(spark, sf_dir, C.GBT)


def q_gbt_reg_forecast(spark, sf_dir):
    return _preds(spark, sf_dir, C.XGB)


def q_gbt_leaf_forecast(spark, sf_dir):
    return _preds(spark, sf_dir, C.LGBM)


def reference_predictions(spark, sf_dir) -> DataFrame:
    """Naive, scaled OLS and kNN on all 24 features, plus the five tree forecasters."""
    train, test = split_frames(spark, sf_dir)
    sc = M.fit_standard(train, FEATS)
    tr, te = sc.apply(train), sc.apply(test)
    _, lr = M.fit_predict(M.linear_regression(FEATS), tr, te, C.LINEAR)
    kp = knn_regress(tr, te, FEATS, C.TARGET, train_order="pos", test_key="datetime", k=10)
    knn = te.select("datetime", F.col(C.TARGET).alias("actual")).join(kp, "datetime").select(
        "datetime", F.lit(C.KNN).alias("model"), "actual", "predicted")
    trees = fitted(spark, sf_dir, [*TREE_MODELS, *BOOSTED])
    parts = [M.naive_forecast(test, "lag_288"), lr, knn, *[r.predictions for r in trees.values()]]
    return M.union_predictions(parts)


def q_model_comparison(spark, sf_dir):
    return rounded(stats.leaderboard(stats.regression_metrics(reference_predictions(spark, sf_dir))))


def boosted_nodes(spark, sf_dir) -> DataFrame:
    """Node tables of the boosted forecasters, stored once per fit and read back."""
    def store():
        path = scratch_path(spark, "tree-nodes")
        runs = fitted(spark, sf_dir, list(BOOSTED))
        M.union_predictions([runs[n].model.nodes(spark, n) for n in BOOSTED]).write.parquet(path)
        return path
    return spark.read.parquet(fit_once(spark, sf_dir, "boosted-nodes", store))


def importances_long(spark, sf_dir) -> DataFrame:
    """(model, feature, importance): the forest's impurity decrease and the depth-wise booster's mean gain per split, each as shares
    of 1, and the leaf-wise booster's number of splits."""
    run = fitted(spark, sf_dir, [C.FOREST])[C.FOREST]
    forest = spark.createDataFrame([(C.FOREST, f, float(v)) for f, v in zip(FEATS, run.model.importances)],
                                   "model string, feature string, importance double")
    counts = boosting.split_counts(boosted_nodes(spark, sf_dir).where(F.col("model") != C.GBT), FEATS)
    mean = F.coalesce(F.try_divide("gain", "splits"), F.lit(0.0))
    share = F.try_divide(mean, F.sum(mean).over(Window.partitionBy("model")))
    boosted = counts.select("model", "feature", F.when(F.col("model") == C.LGBM, F.col("splits").cast("double")).otherwise(share).alias("importance"))
    return forest.unionByName(boosted)


def q_feature_importance(spark, sf_dir):
    imp = importances_long(spark, sf_dir)
    return rounded(an.topk_per_group(imp, "model", "importance", len(FEATS), tiebreak="feature"))


def importances_wide(spark, sf_dir) -> DataFrame:
    return an.align_importances(importances_long(spark, sf_dir), [C.FOREST, C.XGB, C.LGBM], FEATS)


def q_importances_wide(spark, sf_dir):
    return rounded(importances_wide(spark, sf_dir))


def q_topk_features(spark, sf_dir):
    return rounded(an.topk_per_group(importances_long(spark, sf_dir), "model", "importance", 15,
                                     tiebreak="feature"))


def q_report_json(spark, sf_dir):
    return sinks.report_json(board_set(spark, sf_dir), importances_wide(spark, sf_dir))


def fit_history(spark, sf_dir) -> list[tuple]:
    """(iteration, loss, val_loss): squared loss on training and on test rows after each round of the boosted forecaster."""
    rows = ranked_rows(spark, sf_dir)
    end = rows.where(F.col("datetime") < F.to_timestamp_ntz(F.lit(SPLIT))).count()
    parts = {"loss": (0, end), "val_loss": (end, boosting.ALL_ROWS[1])}
    got = boosting.fit_many(rows, [boosting.Spec((n,), M.GRADIENT, (0, end), part) for n, part in parts.items()], FEATS, C.TARGET, "row", keep_trees=False)
    return [(i, *(float(got[(n,)].errors[i]["mse"]) for n in parts)) for i in range(1, M.GRADIENT.rounds + 1)]


def q_fit_history(spark, sf_dir):
    return rounded(spark.createDataFrame(fit_once(spark, sf_dir, "history", lambda: fit_history(spark, sf_dir)), "iteration int, loss double, val_loss double"))


def searched(spark, sf_dir):
    """Both searches (history and best trial of each), once per application and input."""
    def search():
        train, _ = split_frames(spark, sf_dir)
        history, best = tuning.search_all(spark, fp.post_drop_position(train), FEATS, {"xgb": "depthwise", "lgbm": "leafwise"}, N_TRIALS, 3)
        return history, {C.XGB_TUNED: best["xgb"], C.LGBM_TUNED: best["lgbm"]}
    return fit_once(spark, sf_dir, "searched", search)


def tuned(spark, sf_dir):
    """Best trials refitted on all training rows (full tree count), scored on the test rows."""
    hist, best = searched(spark, sf_dir)

    def refit():
        train, test = split_frames(spark, sf_dir)
        models = tuning.refit(best, train, FEATS)
        return M.union_predictions([M.as_long(m.predict(test.select("datetime", C.TARGET, *FEATS)), name) for name, m in models.items()])
    return hist, fit_once(spark, sf_dir, "tuned", refit)


def q_tune_history(spark, sf_dir):
    hist, _ = searched(spark, sf_dir)
    return rounded(stats.running_min(hist, "mae", "trial", ["study"]).drop("params"))


def q_tuned_forecast(spark, sf_dir):
    """Tuned forecasters and their inverse-RMSE ensemble."""
    return rounded(tuned_with_blend(spark, sf_dir))


def q_sequence_forecast(spark, sf_dir):
    """Re-aimed sequence model: 24 x 25 scaled lookback -> ridge regression -> inverse scaling."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression
    cols = [*FEATS, C.TARGET]
    train, _ = split_frames(spark, sf_dir)
    sc = M.fit_minmax(train, cols)
    scaled = fp.post_drop_position(sc.apply(features(spark, sf_dir).select("pos", "datetime", *cols)))
    seq = lookback_sequences(scaled, cols, C.TARGET, 24, pos_col="row", block_size=C.DEFAULT_BLOCK)
    seq = seq.withColumn("features", array_to_vector("seq"))
    cut = F.to_timestamp_ntz(F.lit(SPLIT))
    lr = LinearRegression(featuresCol="features", labelCol="label", regParam=1e-3, elasticNetParam=0.0,
                          solver="normal")
    model = lr.fit(seq.filter(F.col("datetime") < cut))
    out = model.transform(seq.filter(F.col("datetime") >= cut))
    return rounded(out.select("datetime", F.lit(C.SEQUENCE).alias("model"),
                              sc.inverse("label", C.TARGET).alias("actual"),
                              sc.inverse("prediction", C.TARGET).alias("predicted")))


ALL_QUERIES.update({
    "tree_forecast": q_tree_forecast,
    "forest_forecast": q_forest_forecast,
    "gbt_forecast": q_gbt_forecast,
    "gbt_reg_forecast": q_gbt_reg_forecast,
    "gbt_leaf_forecast": q_gbt_leaf_forecast,
    "model_comparison": q_model_comparison,
    "feature_importance": q_feature_importance,
    "importances_wide": q_importances_wide,
    "topk_features": q_topk_features,
    "report_json": q_report_json,
    "fit_history": q_fit_history,
    "tune_history": q_tune_history,
    "tuned_forecast": q_tuned_forecast,
    "sequence_forecast": q_sequence_forecast,
})


# --------------------------------------------------------------------------- multi-series windows

SERIES_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "load"]
SERIES_CADENCE = Cadence(lags=(1, 7, 30), roll=12, seasonal=7, rows_per_day=1)


def q_series_window_features(spark, sf_dir):
    """Per-supplier row lags and trailing statistics of quantity, ordered by ship date.

    The ordered-window operators with ``series_keys``: per-series positions from
    one global sort, then halo blocks partitioned by (series, block).
    """
    li = adapters.table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("load"))
    d = position_index(li, SERIES_ORDER, ["l_suppkey"])
    out = fp.add_window_features(d, SERIES_CADENCE, ["l_suppkey"], block_size=256)
    return rounded(out.select("l_suppkey", "l_orderkey", "l_linenumber", "pos", "load",
                              *SERIES_CADENCE.lag_names, *SERIES_CADENCE.roll_names))


ALL_QUERIES["series_window_features"] = q_series_window_features


def series_features(spark, sf_dir) -> DataFrame:
    raw = adapters.load_series(adapters.table(spark, sf_dir, "events"), 60, ["event_type"])
    eng = fp.engineer(raw, HOURLY, series_keys=["event_type"])
    return drop_incomplete(eng).select("event_type", "datetime", "load", *HOURLY.features)


def q_series_feature_frame(spark, sf_dir):
    """The whole feature pipeline per event type on hourly buckets (series key ``event_type``)."""
    return rounded(series_features(spark, sf_dir))


def series_predictions(spark, sf_dir) -> DataFrame:
    _, test = fp.train_test(series_features(spark, sf_dir), SPLIT)
    return M.naive_forecast(test, "lag_24", keys=("event_type", "datetime"))


def q_series_naive_forecast(spark, sf_dir):
    """Seasonal naive forecast of every series over its test rows."""
    return rounded(series_predictions(spark, sf_dir))


def q_series_metrics(spark, sf_dir):
    """Error metrics per series and model, in one aggregation."""
    return rounded(stats.regression_metrics(series_predictions(spark, sf_dir), ["event_type", "model"]))


def series_linear(spark, sf_dir) -> DataFrame:
    train, test = fp.train_test(series_features(spark, sf_dir), SPLIT)
    return M.series_linear_forecast(train, test, ["lag_1", "roll_mean_12"], ["event_type"])


def q_series_linreg_forecast(spark, sf_dir):
    """Every series' own least-squares forecast on two features, all from one aggregation."""
    return rounded(series_linear(spark, sf_dir))


def q_series_folds(spark, sf_dir):
    """Expanding folds of every series, from its own number of complete rows."""
    rows = fp.post_drop_position(fp.feature_frame(adapters.load_series(adapters.table(spark, sf_dir, "events"), 60, ["event_type"]), HOURLY, ["event_type"]), ["event_type"])
    return cvops.fold_summary(rows, 5, series_keys=["event_type"])


def q_series_tail(spark, sf_dir):
    """The last day of every series and model, of two forecasters."""
    preds = series_predictions(spark, sf_dir).unionByName(series_linear(spark, sf_dir))
    return rounded(an.tail_per_model(preds, HOURLY.rows_per_day, ["event_type"]))


def q_series_residuals(spark, sf_dir):
    """Residuals of every series and model."""
    preds = series_predictions(spark, sf_dir).unionByName(series_linear(spark, sf_dir))
    return rounded(an.residuals(preds, ("event_type", "datetime")))


def q_appended_features(spark, sf_dir):
    """Features of the rows from the split on, from the stored state of the rows before."""
    from voltcast.plans import append
    raw = raw_series(spark, sf_dir, FIVE_MIN)
    before, after = fp.train_test(raw, SPLIT)
    path = scratch_path(spark, "feature-state")
    append.feature_state(before).write.parquet(path)
    found, _ = append.append_features(after, spark.read.parquet(path))
    return rounded(drop_incomplete(found).select("pos", "datetime", C.TARGET, *FEATS))


def correlation_importances(spark, sf_dir) -> DataFrame:
    """(model, feature, importance): absolute correlation of each feature with the load, on training and on test rows."""
    train, test = split_frames(spark, sf_dir)
    named = {"train": train, "test": test}
    corr = lambda c: F.try_divide(F.covar_pop(c, C.TARGET), F.sqrt(F.var_pop(c) * F.var_pop(C.TARGET)))  # null for a constant column
    parts = [d.agg(*[F.abs(corr(c)).alias(c) for c in FEATS]).unpivot([], FEATS, "feature", "importance").select(F.lit(m).alias("model"), "feature", "importance")
             for m, d in named.items()]
    return M.union_predictions(parts)


def q_correlation_importances(spark, sf_dir):
    """Importances side by side in feature order, of two rankings by correlation."""
    return rounded(an.align_importances(correlation_importances(spark, sf_dir), ["train", "test"], FEATS))


def q_topk_correlations(spark, sf_dir):
    """The 15 features of the highest correlation with the load, on training and on test rows."""
    imp = rounded(correlation_importances(spark, sf_dir).where("importance is not null"))
    return an.topk_per_group(imp, "model", "importance", 15, tiebreak="feature")


def q_residual_density_levels(spark, sf_dir):
    return rounded(an.residual_density_levels(prediction_set(spark, sf_dir), 20))


def q_artefact_predictions(spark, sf_dir):
    """Wide predictions written as CSV, and the latest two days of them read back."""
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(an.wide_predictions(prediction_set(spark, sf_dir), SQL_MODELS), path)
    return rounded(readers.read_predictions(spark, path, 2 * FIVE_MIN.rows_per_day))


def q_artefact_trials(spark, sf_dir):
    """Errors of the naive forecast's folds with their running minimum, written as a trial history and read back."""
    path = scratch_path(spark, "trials")
    sinks.write_trials(stats.running_min(cv_naive_frame(spark, sf_dir), "mae", "fold").withColumnRenamed("fold", "trial"), path)
    return rounded(readers.read_trials(spark, path))


def q_artefact_epochs(spark, sf_dir):
    """Mean absolute change of the load over 12 and 288 rows per weekday, written as an epoch history and read back."""
    path = scratch_path(spark, "epochs")
    change = lambda lag: F.avg(F.abs(F.col(C.TARGET) - F.col(lag)))
    sinks.write_fit_history(features(spark, sf_dir).groupBy(F.col("weekday").alias("iteration")).agg(change("lag_12").alias("loss"), change("lag_288").alias("val_loss")), path)
    return rounded(readers.read_epochs(spark, path))


def q_artefact_profile(spark, sf_dir):
    """Feature means: computed and written as a JSON document the first time, read the second."""
    path = scratch_path(spark, "profile")
    readers.profile_document(spark, path, lambda: stats.feature_profile(features(spark, sf_dir), FEATS))
    return rounded(readers.profile_document(spark, path).select(*FEATS))


def q_saved_model_forecast(spark, sf_dir):
    """Least-squares forecaster saved, loaded and scored on the test rows."""
    train, test = split_frames(spark, sf_dir)
    path = scratch_path(spark, "model")
    sinks.save_model(M.linear_regression(LR_COLS).fit(train), path)
    return rounded(sinks.score(sinks.load_model(path), test, C.LINEAR))


ALL_QUERIES.update({"artefact_predictions": q_artefact_predictions, "artefact_trials": q_artefact_trials, "artefact_epochs": q_artefact_epochs,
                    "artefact_profile": q_artefact_profile, "saved_model_forecast": q_saved_model_forecast})
ALL_QUERIES.update({"series_linreg_forecast": q_series_linreg_forecast, "series_folds": q_series_folds, "series_tail": q_series_tail,
                    "series_residuals": q_series_residuals, "appended_features": q_appended_features,
                    "correlation_importances": q_correlation_importances, "topk_correlations": q_topk_correlations,
                    "residual_density_levels": q_residual_density_levels})
ALL_QUERIES["series_feature_frame"] = q_series_feature_frame
ALL_QUERIES["series_naive_forecast"] = q_series_naive_forecast
ALL_QUERIES["series_metrics"] = q_series_metrics


CV_BOOSTER = boosting.Params(rounds=200, depth=6, rate=0.05, l1=0.0, l2=1.0, columns=0.8, rows=0.8)


def cv_boosting_folds(spark, sf_dir) -> DataFrame:
    """Fold MAE of the 200-round boosted forecaster, expanding 5-fold CV on all complete rows; the folds' models are grown together."""
    def fit():
        rows = ranked_rows(spark, sf_dir)
        bounds = cvops.fold_bounds(rows.count(), 5)
        models = boosting.fit_many(rows, [boosting.Spec((f,), CV_BOOSTER, (0, start), (start, end)) for f, start, end in bounds], FEATS, C.TARGET, "row", keep_trees=False)
        return [(f, float(models[(f,)].error("mae"))) for f, _, _ in bounds]
    return spark.createDataFrame(fit_once(spark, sf_dir, "cv-boosting", fit), "fold int, mae double")


def q_cv_boosting(spark, sf_dir):
    """Expanding 5-fold CV of the boosted forecaster: fold MAE, and their mean and standard deviation."""
    per_fold = cv_boosting_folds(spark, sf_dir)
    summary = stats.cv_summary(per_fold, "mae")
    return rounded(per_fold.withColumn("cv_mean_mae", summary.select("cv_mean_mae").scalar())
                   .withColumn("cv_std_mae", summary.select("cv_std_mae").scalar()))


def tuned_with_blend(spark, sf_dir) -> DataFrame:
    _, preds = tuned(spark, sf_dir)
    board = stats.leaderboard(stats.regression_metrics(preds))
    w = M.inverse_rmse_weights(board, [C.XGB_TUNED, C.LGBM_TUNED])
    return preds.unionByName(M.blend(preds, w, C.ENSEMBLE))


def sequence_predictions(spark, sf_dir) -> DataFrame:
    return memo(spark, sf_dir, "sequence-preds", lambda: q_sequence_forecast(spark, sf_dir))


def all_model_predictions(spark, sf_dir) -> DataFrame:
    """Every forecaster of the reference run: 8 base models, 2 tuned, their blend, the sequence model; fitted side by side."""
    features(spark, sf_dir).count()
    with ThreadPoolExecutor(max_workers=3) as ex:
        return M.union_predictions(list(ex.map(lambda build: build(spark, sf_dir), [reference_predictions, tuned_with_blend, sequence_predictions])))


def q_compare_tuned(spark, sf_dir):
    """Default vs tuned boosters and the blend, per metric, with the best of them by RMSE."""
    board = stats.leaderboard(stats.regression_metrics(all_model_predictions(spark, sf_dir)))
    return rounded(an.compare_models(board, [C.XGB, C.XGB_TUNED, C.LGBM, C.LGBM_TUNED, C.ENSEMBLE]))


def q_final_metrics(spark, sf_dir):
    """The final metrics table of the run (rounded, sorted by RMSE, display names)."""
    board = stats.leaderboard(stats.regression_metrics(all_model_predictions(spark, sf_dir)))
    return sinks.metrics_for_export(board)


def q_model_invariants(spark, sf_dir):
    """What must hold of every fitted tree forecaster: one finite prediction per test time, inside the range of the training
    loads for single trees and averages of trees, and a smaller error than the mean of the test loads."""
    train, _ = split_frames(spark, sf_dir)
    names = [*TREE_MODELS, *BOOSTED]
    preds = M.union_predictions([r.predictions for r in fitted(spark, sf_dir, names).values()])
    low, high = train.agg(F.min(C.TARGET)).scalar(), train.agg(F.max(C.TARGET)).scalar()
    inside = F.col("predicted").between(low - F.lit(1e-9), high + F.lit(1e-9)) | F.col("model").isin(list(BOOSTED))
    err = F.col("actual") - F.col("predicted")
    return rounded(preds.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("datetime").alias("n_times"), F.avg("actual").alias("mean_actual"),
        F.min(inside & F.col("predicted").isNotNull() & ~F.isnan("predicted")).alias("in_range"),
        (F.avg(err * err) < F.var_pop("actual")).alias("beats_mean")))


def q_importance_invariants(spark, sf_dir):
    """Of every model with importances: one per feature, none negative, and their shares add up to 1."""
    imp = importances_long(spark, sf_dir)
    share = F.col("importance") / F.sum("importance").over(Window.partitionBy("model"))
    return rounded(imp.withColumn("share", share).groupBy("model").agg(
        F.countDistinct("feature").alias("n_features"), (F.min("importance") >= 0).alias("none_negative"), F.sum("share").alias("total")))


def q_history_invariants(spark, sf_dir):
    """Of the boosted forecaster's history: every round once, and both losses end below where they began."""
    order = lambda c, pick: pick(c, "iteration")
    return q_fit_history(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_rounds"), F.countDistinct("iteration").alias("n_distinct"),
        (order("loss", F.max_by) < order("loss", F.min_by)).alias("loss_falls"),
        (order("val_loss", F.max_by) < order("val_loss", F.min_by)).alias("val_loss_falls"))


ALL_QUERIES["model_invariants"] = q_model_invariants
ALL_QUERIES["importance_invariants"] = q_importance_invariants
ALL_QUERIES["history_invariants"] = q_history_invariants
ALL_QUERIES["compare_tuned"] = q_compare_tuned
ALL_QUERIES["cv_boosting"] = q_cv_boosting
ALL_QUERIES["final_metrics"] = q_final_metrics


# Registry order: queries on data first, then those on fitted models from the
# cheapest to the most expensive (later ones reuse earlier fits).
_ROWS_ONLY = ["tree_forecast", "sequence_forecast", "gbt_forecast", "gbt_reg_forecast", "gbt_leaf_forecast", "fit_history",
              "history_invariants", "cv_boosting", "forest_forecast", "model_invariants", "importance_invariants",
              "feature_importance", "importances_wide", "topk_features", "report_json", "model_comparison", "tune_history",
              "tuned_forecast", "compare_tuned", "final_metrics"]
ALL_QUERIES = {**{k: v for k, v in ALL_QUERIES.items() if k not in _ROWS_ONLY},
               **{k: ALL_QUERIES[k] for k in _ROWS_ONLY}}
