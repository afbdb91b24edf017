"""Golden checks against the reference's stored result tables (typed inline)."""

import numpy as np
import pytest

from voltcast import constants as C
from voltcast.operators import stats
from voltcast.plans import analytics as an
from voltcast.plans import models as M

# FIXED VALUES: stored search histories (MAE per trial 1..50, in trial order)
XGB_TRIAL_MAE = [
    42.87322961770905, 77.71485566878435, 43.138935042199186, 48.076969916343394, 59.96429534116672,
    46.89854917622534, 44.905327877396644, 73.30465467543334, 49.35926028507192, 142.29279789467958,
    43.48350328155181, 42.94272016031861, 43.192983971842125, 42.98541532782426, 42.260506489147325,
    42.06065974818449, 44.236858023152365, 47.17160540761049, 42.15813306747358, 43.052286359277964,
    41.718389558535755, 41.79194652848062, 42.34589740488091, 41.69251488562528, 41.82490051942414,
    64.02796004740391, 42.27524892778242, 41.77972842656894, 41.56962080749025, 41.82094786008426,
    41.950061433321046, 41.71767376982054, 77.69029371081076, 42.77614605882166, 43.86303900683339,
    41.710346499134715, 41.95076306394603, 41.899195762394335, 88.4899708834587, 42.189642747973004,
    41.71727487615582, 41.70542717634618, 41.896816281894026, 41.84382584989467, 41.757492084794585,
    41.96205965554761, 41.99009232202267, 41.562667016541646, 44.51305811968555, 41.60037576829472,
]
LGBM_TRIAL_MAE = [
    47.775367694786524, 46.78865756991181, 144.49364691342691, 70.00972160954954, 46.48641393167173,
    41.23671067110755, 49.39765973157444, 42.032402865024835, 39.57844460576161, 365.7097196289632,
    39.39311579116599, 39.616242623864096, 38.57118878736907, 39.09049336535701, 38.47755406144753,
    37.760824561461625, 37.159378317288116, 37.17962900148946, 37.695438591868346, 176.11113883985445,
    42.754569711298, 37.62605640139024, 37.47784651944713, 38.05922268318557, 37.19248490483154,
    37.75814185048083, 37.55030129145945, 177.8923547422602, 37.808125327128785, 37.795149256608134,
    37.82034471132885, 37.47998392086786, 37.611220491436576, 39.578783479839466, 107.2242740125307,
    37.41848521747148, 37.623589173432435, 38.1956750168747, 154.343108374976, 48.16791174461934,
    38.0445860330503, 37.76141013046881, 39.63043191602924, 37.21175564990143, 40.53131211418124,
    37.38865514552904, 37.58295120512338, 37.35843343422487, 37.16792128059928, 37.970476936536045,
]
# FIXED VALUES: stored epoch history (epoch, loss, validation loss)
EPOCHS = [
    (1, 0.0019629227463155985, 0.0015235726023092866),
    (2, 0.0005944943986833096, 0.0015749781159684062),
    (3, 0.00039189658127725124, 0.001599506358616054),
    (4, 0.00029969887691549957, 0.0017488306621089578),
    (5, 0.00023781234631314874, 0.0020803099032491446),
    (6, 0.00021656311582773924, 0.001898878370411694),
]
# FIXED VALUES: stored final metrics (model, MAE, RMSE, R², MAPE %) and configuration
METRICS = [
    ("Linear Regression", 37.106, 87.702, 0.996, 0.87),
    ("Random Forest", 43.335, 107.974, 0.994, 0.951),
    ("Decision Tree", 56.911, 123.015, 0.992, 1.277),
    ("Gradient Boosting", 57.676, 123.072, 0.992, 1.275),
    ("LightGBM (Tuned)", 53.077, 131.433, 0.991, 1.097),
    ("LightGBM", 57.768, 131.813, 0.991, 1.222),
    ("Ensemble (XGB+LGBM)", 55.516, 144.873, 0.989, 1.123),
    ("XGBoost", 59.694, 157.473, 0.987, 1.221),
    ("XGBoost (Tuned)", 61.177, 173.562, 0.985, 1.213),
    ("KNN", 274.47, 372.221, 0.929, 6.39),
    ("LSTM", 311.896, 383.865, 0.925, 6.354),
    ("Naive Baseline", 598.427, 903.007, 0.583, 15.19),
]
CONFIG = {"w_xgb": 0.43093493335956323, "w_lgbm": 0.5690650666404368, "best_model": "Linear Regression"}


@pytest.mark.parametrize("maes,best_trial", [(XGB_TRIAL_MAE, 48), (LGBM_TRIAL_MAE, 17)])
def test_search_history_golden(spark, maes, best_trial):
    df = spark.createDataFrame([(i + 1, m) for i, m in enumerate(maes)], "trial int, mae double")
    rm = stats.running_min(df, "mae", "trial").orderBy("trial").toPandas()["running_min"].to_numpy()
    np.testing.assert_array_equal(rm, np.minimum.accumulate(np.array(maes)))
    b = stats.best_of_history(df, "mae", "trial").first()
    assert b.best_trial == best_trial and b.best_mae == min(maes)


def test_epoch_history_best_epoch(spark):
    df = spark.createDataFrame(EPOCHS, "epoch int, loss double, val_loss double")
    assert stats.best_of_history(df, "val_loss", "epoch").first().best_epoch == 1


def _board(spark):
    m = spark.createDataFrame(METRICS, "model string, MAE double, RMSE double, R2 double, MAPE double")
    return stats.leaderboard(m)


def test_leaderboard_and_config_golden(spark):
    board = _board(spark)
    order = [r.model for r in board.orderBy("rank").collect()]
    assert order == [m[0] for m in METRICS]  # the stored table is sorted by RMSE
    w = {r.model: r.weight for r in M.inverse_rmse_weights(board, [C.XGB_TUNED, C.LGBM_TUNED]).collect()}
    assert w[C.XGB_TUNED] == pytest.approx(CONFIG["w_xgb"], abs=1e-12)
    assert w[C.LGBM_TUNED] == pytest.approx(CONFIG["w_lgbm"], abs=1e-12)
    assert board.filter("rank = 1").first().model == CONFIG["best_model"]
    status = {r.model: r.status for r in an.model_status(board).collect()}
    assert status["Linear Regression"] == "BEST FIT" and status["Ensemble (XGB+LGBM)"] == "ACTIVE"
    assert status["Naive Baseline"] == "BASELINE" and status["KNN"] == "STANDBY"
