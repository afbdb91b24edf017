"""Forecasters on Spark ML, and their evaluation.

Every forecaster produces long predictions ``(datetime, model, actual, predicted)``
for the test rows. Fitting runs on executors (tree statistics are aggregated
per level; only split decisions reach the driver); the driver only orchestrates.

Re-aimed models (no twin in MLlib) say so in their docstring.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltcast import constants as C
from voltcast.operators import boosting, forest
from voltcast.operators.ordered import fit_input, same_keys


def assembler(cols: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error")


def standard_scaled(cols: Sequence[str]) -> list:
    """Assemble then standardise (mean removed, unit sample std), fitted on train only."""
    return [assembler(cols, "raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]


# --------------------------------------------------------------------------- estimators

def linear_regression(cols: Sequence[str], scaled: bool = False, label: str = C.TARGET) -> Pipeline:
    """Ordinary least squares with intercept (exact normal-equation solve).

    The reference scales its inputs first; OLS predictions do not change under
    per-column affine scaling, so callers scale with :func:`fit_standard` only
    when the scaled coefficients themselves are wanted.
    """
    stages = standard_scaled(cols) if scaled else [assembler(cols)]
    lr = LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0,
                          elasticNetParam=0.0, fitIntercept=True, standardization=False)
    return Pipeline(stages=[*stages, lr])


def decision_tree(cols: Sequence[str], label: str = C.TARGET, seed: int = 42) -> Pipeline:
    dt = DecisionTreeRegressor(featuresCol="features", labelCol=label, maxDepth=10, minInstancesPerNode=10,
                               seed=seed)
    return Pipeline(stages=[assembler(cols), dt])


# 150 trees of depth 15, min leaf 4; every split considers all features (operators.forest).
BAGGED = forest.Params(trees=150, depth=15, min_rows=4, bins=32, seed=42)
# Plain squared-loss boosting: 200 rounds of depth 5, rate .05, rows sampled 0.8, no penalties (operators.boosting).
GRADIENT = boosting.Params(rounds=200, depth=5, rate=0.05, l1=0.0, l2=0.0, columns=1.0, rows=0.8)
# Second-order boosting with L1 and L2 leaf penalties (operators.boosting).
# Depth-wise: 300 x depth 6, rate .05, rows and features sampled 0.8 per tree.
REGULARISED = boosting.Params(rounds=300, depth=6, rate=0.05, l1=0.1, l2=1.0, columns=0.8, rows=0.8)
# Leaf-wise: best gain first, at most 31 leaves of 20 rows or more, depth at most 6.
LEAF_WISE = boosting.Params(rounds=300, depth=6, rate=0.05, leaves=31, min_rows=20, l1=0.1, l2=1.0, columns=0.8, rows=1.0)


# --------------------------------------------------------------------------- predictions

def as_long(scored: DataFrame, name: str, label: str = C.TARGET, pred_col: str = "prediction",
            keys: Sequence[str] = ("datetime",)) -> DataFrame:
    return scored.select(*keys, F.lit(name).alias("model"), F.col(label).alias("actual"),
                         F.col(pred_col).cast("double").alias("predicted"))


def naive_forecast(test: DataFrame, seasonal_col: str = "lag_288", name: str = C.NAIVE,
                   label: str = C.TARGET, keys: Sequence[str] = ("datetime",)) -> DataFrame:
    """Seasonal naive: the value one season (288 rows = one day) earlier."""
    return test.select(*keys, F.lit(name).alias("model"), F.col(label).alias("actual"),
                       F.col(seasonal_col).alias("predicted"))


def fit_predict(pipeline: Pipeline, train: DataFrame, test: DataFrame, name: str,
                label: str = C.TARGET) -> tuple[PipelineModel, DataFrame]:
    model = pipeline.fit(fit_input(train))
    return model, as_long(model.transform(test), name, label)


def fit_boosted(params: dict[str, boosting.Params], train: DataFrame, test: DataFrame, cols: Sequence[str], label: str = C.TARGET,
                row_col: str = "pos", keys: Sequence[str] = ("datetime",)) -> dict[str, ModelRun]:
    """Fit boosted models side by side on all training rows and score the test rows."""
    fitted = boosting.fit_many(train, [boosting.Spec((n,), p, boosting.ALL_ROWS) for n, p in params.items()], cols, label, row_col)
    return {n: ModelRun(n, fitted[(n,)], as_long(fitted[(n,)].predict(test.select(*keys, label, *cols)), n, label, keys=keys)) for n in params}


def fit_forest(name: str, params: forest.Params, train: DataFrame, test: DataFrame, cols: Sequence[str], label: str = C.TARGET,
               row_col: str = "pos", keys: Sequence[str] = ("datetime",)) -> ModelRun:
    """Fit a random forest on all training rows and score the test rows."""
    model = forest.fit(train, params, cols, label, row_col)
    return ModelRun(name, model, as_long(model.predict(test.select(*keys, label, *cols)), name, label, keys=keys))


@dataclass
class ModelRun:
    name: str
    model: PipelineModel | boosting.Boosted | forest.Forest | None
    predictions: DataFrame
    extras: dict = field(default_factory=dict)


def fit_all(specs: dict[str, Pipeline], train: DataFrame, test: DataFrame, label: str = C.TARGET,
            parallelism: int = 4) -> dict[str, ModelRun]:
    """Fit every pipeline (bounded thread pool: Spark runs the jobs concurrently)."""
    def one(item):
        name, pipe = item
        m, p = fit_predict(pipe, train, test, name, label)
        return name, ModelRun(name, m, p)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        return dict(ex.map(one, specs.items()))


def union_predictions(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --------------------------------------------------------------------------- many series at once

def linear_coefficients(train: DataFrame, cols: Sequence[str], series_keys: Sequence[str], label: str = C.TARGET) -> DataFrame:
    """(series, n, intercept, weights): least squares with intercept of every series, in one aggregation.

    The Gram matrix is taken about the means (population covariances, merged
    stably from partial moments), d (d + 3) / 2 numbers per series, and solved
    where the series' row is; a singular one gets the solution of least norm. Rows
    with a null label or feature do not count.
    """
    d = len(cols)
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    y = F.col(label).cast("double")
    rows = train.dropna(subset=[label, *cols])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy(*series_keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in x]).alias("_mean"), F.avg(y).alias("_ybar"),
        F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("_gram"), F.array(*[F.covar_pop(c, y) for c in x]).alias("_cross"))

    def solve(batches):
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            weights, intercept = [], []
            for mean, ybar, gram, cross in zip(*(batch.column(at[c]).to_pylist() for c in ("_mean", "_ybar", "_gram", "_cross"))):
                full = np.zeros((d, d))
                for (i, j), v in zip(pairs, gram):
                    full[i, j] = full[j, i] = v
                # scaled to unit variance first, so that the rank does not hang on the units
                scale = np.sqrt(np.where(np.diag(full) > 0, np.diag(full), 1.0))
                w = np.linalg.lstsq(full / np.outer(scale, scale), np.array(cross) / scale, rcond=1e-12)[0] / scale
                weights.append(w.tolist())
                intercept.append(float(ybar - np.dot(w, mean)))
            keep = [batch.column(at[c]) for c in [*series_keys, "n"]]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(intercept, pa.float64()), pa.array(weights, pa.list_(pa.float64()))], [*series_keys, "n", "intercept", "weights"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name in series_keys)
    return sums.mapInArrow(solve, f"{kinds}, n long, intercept double, weights array<double>")


def series_linear_forecast(train: DataFrame, test: DataFrame, cols: Sequence[str], series_keys: Sequence[str], label: str = C.TARGET,
                           keys: Sequence[str] = ("datetime",), name: str = C.LINEAR) -> DataFrame:
    """Long predictions of every series by its own linear model; a series without training rows has null predictions."""
    scored = same_keys(test, linear_coefficients(train, cols, series_keys, label).drop("n"), series_keys, "left")
    dot = sum((F.col("weights")[i] * F.col(f"`{c}`") for i, c in enumerate(cols)), F.col("intercept"))
    return as_long(scored.withColumn("prediction", dot), name, label, keys=[*series_keys, *keys])


# --------------------------------------------------------------------------- ensemble

def inverse_rmse_weights(board: DataFrame, components: Sequence[str], model_col: str = "model") -> DataFrame:
    """w_i = (1/RMSE_i) / sum_j (1/RMSE_j) over the named components (from the rounded board)."""
    comp = board.filter(F.col(model_col).isin(list(components))).select(
        F.col(model_col).alias("model"), F.try_divide(F.lit(1.0), F.col("RMSE")).alias("_inv"))
    total = comp.agg(F.sum("_inv")).scalar()
    return comp.select("model", (F.col("_inv") / total).alias("weight"))


def blend(predictions: DataFrame, weights: DataFrame, name: str, keys: Sequence[str] = ("datetime",)) -> DataFrame:
    """Weighted sum of component predictions per row, named by ``keys`` (with the position where timestamps tie).

    The weight table has one row per component model (a proven, tiny bound), so
    it is broadcast; the blend is one aggregation.
    """
    d = predictions.join(F.broadcast(weights), "model")
    return (d.groupBy(*keys).agg(F.first("actual").alias("actual"),
                                 F.sum(F.col("weight") * F.col("predicted")).alias("predicted"))
            .select(*keys, F.lit(name).alias("model"), "actual", "predicted"))


# --------------------------------------------------------------------------- scalers (M1, M2)

@dataclass
class ColumnScaler:
    """Per-column affine transform ``(x - shift) / scale`` fitted on training rows.

    Fitting is one aggregation; the fitted parameters (two numbers per column)
    are the model and are kept on the driver like any fitted model.
    """

    shift: dict
    scale: dict

    def apply(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.shift:
                out.append(((F.col(c) - F.lit(self.shift[c])) / F.lit(self.scale[c])).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)

    def inverse(self, col: str, name: str):
        return F.col(col) * F.lit(self.scale[name]) + F.lit(self.shift[name])


def fit_standard(train: DataFrame, cols: Sequence[str]) -> ColumnScaler:
    """Mean and population std (ddof=0); a constant column gets scale 1 (sklearn's rule)."""
    row = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    shift = {c: float(row[f"m{i}"]) for i, c in enumerate(cols)}
    scale = {c: (float(row[f"s{i}"]) if row[f"s{i}"] else 1.0) for i, c in enumerate(cols)}
    return ColumnScaler(shift, scale)


def fit_minmax(train: DataFrame, cols: Sequence[str]) -> ColumnScaler:
    """Min-max to [0, 1]; a constant column maps to 0 (sklearn), not 0.5 (MLlib)."""
    row = train.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                    *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    shift = {c: float(row[f"lo{i}"]) for i, c in enumerate(cols)}
    scale = {c: (float(row[f"hi{i}"]) - float(row[f"lo{i}"])) or 1.0 for i, c in enumerate(cols)}
    return ColumnScaler(shift, scale)
