"""Hyper-parameter search for the boosted forecasters (re-aimed from a TPE sampler).

Seeded random search over the reference's spaces; each trial is scored by the
mean validation MAE over expanding time folds of the training rows. All (study,
trial, fold) models are grown together by ``operators.boosting``: rows are binned
once and folds are row ranges. A model stops when its validation error has not
fallen for ``PATIENCE`` rounds and is cut back to its best round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from voltcast import constants as C
from voltcast.operators import boosting
from voltcast.operators.cv import fold_bounds

PATIENCE = 20


@dataclass(frozen=True)
class Trial:
    number: int
    params: dict


def sample_depthwise(rng: np.random.RandomState) -> dict:
    """Trees 100-600 step 50, depth 3-10, learning rate log-uniform 0.005-0.3."""
    return {"n_estimators": int(rng.choice(np.arange(100, 601, 50))),
            "max_depth": int(rng.randint(3, 11)),
            "learning_rate": float(math.exp(rng.uniform(math.log(0.005), math.log(0.3))))}


def sample_leafwise(rng: np.random.RandomState) -> dict:
    """Leaves 20-300, min child 5-100, trees 100-600/50, lr .005-.3 log, depth 3-12, colsample .5-1."""
    return {"num_leaves": int(rng.randint(20, 301)),
            "min_child_samples": int(rng.randint(5, 101)),
            "n_estimators": int(rng.choice(np.arange(100, 601, 50))),
            "learning_rate": float(math.exp(rng.uniform(math.log(0.005), math.log(0.3)))),
            "max_depth": int(rng.randint(3, 13)),
            "colsample_bytree": float(rng.uniform(0.5, 1.0))}


def model_params(params: dict, patience: int | None = None, seed: int = 42) -> boosting.Params:
    """A trial's parameters as those of a model.

    Depth-wise models sample 0.8 of rows and features per tree and stop on the
    MAE; leaf-wise ones stop on the squared error and use all rows, as the
    reference's row share has no effect there without a sampling frequency.
    """
    shared = dict(rounds=params["n_estimators"], depth=params["max_depth"], rate=params["learning_rate"], l1=0.1, l2=1.0, patience=patience, seed=seed)
    if "num_leaves" in params:
        return boosting.Params(**shared, leaves=params["num_leaves"], min_rows=params["min_child_samples"], columns=params["colsample_bytree"], rows=1.0, metric="mse")
    return boosting.Params(**shared, columns=0.8, rows=0.8, metric="mae")


def search_all(spark: SparkSession, train_rows: DataFrame, cols: Sequence[str], studies: dict[str, str], n_trials: int = 50,
               k: int = 3, seed: int = 42, parallelism: int = 8, label: str = C.TARGET, row_col: str = "row",
               patience: int = PATIENCE) -> tuple[DataFrame, dict[str, Trial]]:
    """Run the studies ({name: space}); returns the history (study, trial, mae, rounds, params, n_trials) and each study's best trial.

    ``rounds`` is the mean number of rounds that the folds' models were cut back to.
    """
    samplers = {"depthwise": sample_depthwise, "leafwise": sample_leafwise}
    trials = {}
    for study, space in studies.items():
        rng = np.random.RandomState(seed)
        trials[study] = [Trial(i + 1, samplers[space](rng)) for i in range(n_trials)]
    rows = train_rows.select(row_col, label, *cols).persist()
    try:
        folds = fold_bounds(rows.count(), k)
        specs = [boosting.Spec((s, t.number, f), model_params(t.params, patience, seed), (0, start), (start, end))
                 for s in trials for t in trials[s] for f, start, end in folds]
        fitted = boosting.fit_many(rows, specs, cols, label, row_col, keep_trees=False, runs=parallelism)
    finally:
        rows.unpersist()
    history, best = [], {}
    for s, own in trials.items():
        models = [[fitted[(s, t.number, f)] for f, _, _ in folds] for t in own]
        mae = [float(np.mean([m.error("mae") for m in x])) for x in models]
        history += [(s, t.number, e, float(np.mean([m.best_round for m in x])), str(t.params), n_trials) for t, e, x in zip(own, mae, models)]
        best[s] = own[int(np.argmin(mae))]
    return spark.createDataFrame(history, "study string, trial int, mae double, rounds double, params string, n_trials int"), best


def refit(best: dict[str, Trial], train: DataFrame, cols: Sequence[str], label: str = C.TARGET, row_col: str = "pos", seed: int = 42) -> dict[str, boosting.Boosted]:
    """Refit each study's best parameters on all training rows with the full tree count (no early stop), together."""
    specs = [boosting.Spec((s,), model_params(t.params, seed=seed), boosting.ALL_ROWS) for s, t in best.items()]
    return {name: model for (name,), model in boosting.fit_many(train, specs, cols, label, row_col).items()}
