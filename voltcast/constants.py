"""Fixed values shared by the whole library.

Everything under "FIXED VALUES" must equal the reference's choices for results to
match; the rest are our own parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES (feature names and order, flag ranges, model labels, code names)
# ---------------------------------------------------------------------------

# The 24 model features, in model-input order (5-minute cadence).
FEATURES_5MIN = [
    "hour_sin", "hour_cos", "month_sin", "month_cos",
    "weekday", "weekend", "is_peak_hour", "is_day",
    "temp", "dwpt", "rhum", "wspd", "pres",
    "wdir_sin", "wdir_cos",
    "temp_hour", "temp_x_peak",
    "lag_12", "lag_288", "lag_2016",
    "roll_mean_12", "roll_std_12", "roll_max_12", "roll_min_12",
]
TARGET = "load"

# Inclusive hour ranges of the two day flags.
PEAK_HOURS = (18, 21)
DAY_HOURS = (6, 18)
WEEKEND_FROM = 5  # weekday index, Monday = 0

# Columns of the correlation heat map, in display order.
HEATMAP_FEATURES = [
    "temp", "dwpt", "rhum", "wspd", "pres",
    "lag_12", "lag_288", "lag_2016",
    "roll_mean_12", "roll_std_12", "roll_max_12", "roll_min_12",
    "temp_hour", "temp_x_peak",
    "weekday", "weekend", "is_peak_hour", "is_day",
    "load",
]

# Model display names.
NAIVE = "Naive Baseline"
LINEAR = "Linear Regression"
TREE = "Decision Tree"
FOREST = "Random Forest"
KNN = "KNN"
GBT = "Gradient Boosting"
XGB = "XGBoost"
LGBM = "LightGBM"
XGB_TUNED = "XGBoost (Tuned)"
LGBM_TUNED = "LightGBM (Tuned)"
ENSEMBLE = "Ensemble (XGB+LGBM)"
SEQUENCE = "Sequence Ridge"   # the re-aimed sequence model is a ridge regression, and is called so

# Dashboard code names per model; unknown models keep their own name.
MODEL_CODENAMES = {
    "Linear Regression": "LR_BASELINE_V1",
    "Decision Tree": "DT_TREE_V2",
    "Random Forest": "RF_FOREST_V3",
    "KNN": "KNN_NEIGHBOR_V1",
    "Gradient Boosting": "GB_BOOSTER_V2",
    "XGBoost (Tuned)": "XGB_TUNED_V4",
    "XGBoost": "XGB_TUNED_V4",
    "LightGBM (Tuned)": "LGBM_TUNED_V3",
    "LightGBM": "LGBM_TUNED_V3",
    "Ensemble (XGB+LGBM)": "ENS_BLENDED_V2",
    "LSTM": "LSTM_NEURAL_V5",
}

# Status badges of the comparison table.
STATUS_BEST = "BEST FIT"
STATUS_ACTIVE = "ACTIVE"
STATUS_BASELINE = "BASELINE"
STATUS_STANDBY = "STANDBY"

# Relative bar height: best model 85, floor 15.
RELATIVE_SCALE = 85.0
RELATIVE_FLOOR = 15.0

# Default 50/50 blend weights when no config document exists.
DEFAULT_WEIGHTS = {"w_xgb": 0.5, "w_lgbm": 0.5}

# ---------------------------------------------------------------------------
# Our parameters
# ---------------------------------------------------------------------------

# Default block size (rows) for halo-blocked ordered windows.
DEFAULT_BLOCK = 65_536


@dataclass(frozen=True)
class Cadence:
    """Row-count parameters of one sampling cadence.

    ``lags`` are the three lag features (in rows), ``roll`` the trailing
    window of the rolling statistics, ``seasonal`` the lag used by the naive
    forecast and ``rows_per_day`` the length of "one day" for tails.
    """

    lags: tuple[int, int, int]
    roll: int
    seasonal: int
    rows_per_day: int

    @property
    def lag_names(self) -> list[str]:
        return [f"lag_{k}" for k in self.lags]

    @property
    def roll_names(self) -> list[str]:
        return [f"roll_{s}_{self.roll}" for s in ("mean", "std", "max", "min")]

    @property
    def features(self) -> list[str]:
        return FEATURES_5MIN[:17] + self.lag_names + self.roll_names

    @property
    def halo(self) -> int:
        return max(max(self.lags), self.roll + 1)


FIVE_MIN = Cadence(lags=(12, 288, 2016), roll=12, seasonal=288, rows_per_day=288)
HOURLY = Cadence(lags=(1, 24, 168), roll=12, seasonal=24, rows_per_day=24)
