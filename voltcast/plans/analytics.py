"""Result-table analytics: leaderboards, residual statistics, reshaping, top-k.

Inputs are long predictions ``(datetime, model, actual, predicted)`` and the
metrics table of :func:`voltcast.operators.stats.regression_metrics`. Everything
is a DataFrame plan; per-model tables (a handful of rows) are the only sides
broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltcast import constants as C
from voltcast.operators import stats


def residuals(preds: DataFrame, keys: Sequence[str] = ("datetime",)) -> DataFrame:
    r = F.col("actual") - F.col("predicted")
    return preds.select(*keys, "model", r.alias("residual"), F.abs(r).alias("abs_residual"))


def model_status(metrics: DataFrame, baseline: str = C.NAIVE) -> DataFrame:
    """BEST FIT (lowest RMSE), ACTIVE (name contains 'Ensemble'), BASELINE, else STANDBY.

    The dashboard hard-codes its best model's name; we mark whichever model has
    the lowest RMSE (ties by name), which is the same model on the reference's data.
    """
    best = metrics.orderBy("RMSE", "model").limit(1).select(F.col("model").alias("_best"))
    d = metrics.join(F.broadcast(best), F.col("model") == F.col("_best"), "left")
    status = (F.when(F.col("_best").isNotNull(), F.lit(C.STATUS_BEST))
              .when(F.col("model").contains("Ensemble"), F.lit(C.STATUS_ACTIVE))
              .when(F.col("model") == baseline, F.lit(C.STATUS_BASELINE))
              .otherwise(F.lit(C.STATUS_STANDBY)))
    return d.select("model", status.alias("status"))


def model_codename(df: DataFrame, model_col: str = "model") -> DataFrame:
    """Look up the display code name; unknown models keep their own name."""
    pairs = []
    for k, v in C.MODEL_CODENAMES.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    return df.withColumn("codename", F.coalesce(F.element_at(m, F.col(model_col)), F.col(model_col)))


def column_fallback(primary: str, fallback: str):
    """Primary value unless null or 0 (JavaScript truthiness), else the fallback."""
    return F.coalesce(F.nullif(F.col(f"`{primary}`"), F.lit(0.0)), F.col(f"`{fallback}`"))


TUNED_SUFFIX = " (Tuned)"  # fixed value: label suffix of a tuned model


def resolve_model_column(columns: Sequence[str], name: str) -> str | None:
    """The model's own column if present, else its default (untuned) model's column, else None."""
    if name in columns:
        return name
    if name.endswith(TUNED_SUFFIX) and name[: -len(TUNED_SUFFIX)] in columns:
        return name[: -len(TUNED_SUFFIX)]
    return None


def shown_prediction(wide: DataFrame, selected: str, fallback: str) -> DataFrame:
    """Per timestamp: the selected model's prediction (resolving tuned -> default columns),
    falling back to ``fallback`` when the value is null or 0."""
    sel = resolve_model_column(wide.columns, selected)
    fb = resolve_model_column(wide.columns, fallback)
    if sel is None:
        return wide.select("datetime", F.col(f"`{fb}`").alias("shown"))
    return wide.select("datetime", column_fallback(sel, fb).alias("shown"))


def relative_score(metrics: DataFrame) -> DataFrame:
    """Bar height: (max - rmse) / (max - min) x 85, at least 15."""
    hi = metrics.agg(F.max("RMSE")).scalar()
    lo = metrics.agg(F.min("RMSE")).scalar()
    raw = F.try_divide(hi - F.col("RMSE"), hi - lo) * F.lit(C.RELATIVE_SCALE)
    return metrics.select("model", "RMSE",
                          F.greatest(F.lit(C.RELATIVE_FLOOR), F.coalesce(raw, F.lit(0.0))).alias("score"))


def wide_predictions(preds: DataFrame, models: Sequence[str], keys: Sequence[str] = ("datetime",)) -> DataFrame:
    """Keys, Actual, one column per model, in one aggregation.

    ``keys`` name a prediction row: add the row position (and series keys) where
    timestamps tie, else tied rows become one.
    """
    return preds.groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in models],
                                    F.max("actual").alias("Actual"))


def long_predictions(wide: DataFrame, models: Sequence[str], keys: Sequence[str] = ("datetime",)) -> DataFrame:
    cols = ["Actual", *models]
    return wide.unpivot(list(keys), [f"`{c}`" for c in cols], "series", "value")


def metrics_long(metrics: DataFrame, metric_cols: Sequence[str] = ("MAE", "RMSE", "MAPE")) -> DataFrame:
    """(model, metric, value) with the rank inside each metric (ascending) and a best flag."""
    long = metrics.unpivot(["model"], list(metric_cols), "metric", "value")
    w = Window.partitionBy("metric").orderBy("value", "model")
    return long.withColumn("metric_rank", F.row_number().over(w)).withColumn(
        "is_best", (F.col("metric_rank") == 1).cast("int"))


def best_value(metrics: DataFrame, col: str):
    """Scalar subquery: ``col`` of the lowest-RMSE model (ties by model name)."""
    return metrics.agg(F.min_by(F.col(col), F.struct("RMSE", "model"))).scalar()


def compare_models(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per metric, one column per compared model, and the best of them by RMSE."""
    chosen = metrics.filter(F.col("model").isin(list(models)))
    long = chosen.unpivot(["model"], ["MAE", "RMSE", "R2", "MAPE"], "metric", "value")
    wide = long.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))
    return wide.withColumn("best_model", best_value(chosen, "model"))


def topk_per_group(df: DataFrame, group_col: str | Sequence[str], order_col: str, k: int, desc: bool = True,
                   tiebreak: str | None = None) -> DataFrame:
    """Top k rows per group (planned as a partial WindowGroupLimit before the shuffle); ties go to the smallest ``tiebreak``."""
    groups = [group_col] if isinstance(group_col, str) else list(group_col)
    o = F.col(order_col).desc() if desc else F.col(order_col).asc()
    w = Window.partitionBy(*groups).orderBy(o, *([F.col(tiebreak)] if tiebreak else []))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tail_per_model(preds: DataFrame, n: int, series_keys: Sequence[str] = (), tiebreak: str | None = None) -> DataFrame:
    """Latest n rows per model (and series); n <= 0 keeps everything. ``tiebreak`` decides between equal times, where there are any."""
    if n <= 0:
        return preds
    return topk_per_group(preds, [*series_keys, "model"], "datetime", n, tiebreak=tiebreak).drop("rank")


def top_models_zoom(preds: DataFrame, board: DataFrame, top: int, last_rows: int) -> DataFrame:
    """Actual plus the ``top`` best models' predictions over the last ``last_rows`` rows, long form."""
    best = board.filter(F.col("rank") <= top).select("model")  # at most ``top`` rows
    chosen = preds.join(F.broadcast(best), "model", "left_semi")
    tail = tail_per_model(chosen, last_rows)
    # the actuals are those of the best model's rows: all models are scored on the same ones
    first = board.filter(F.col("rank") == 1).select("model")
    actual = tail.join(F.broadcast(first), "model", "left_semi")
    return (tail.select("datetime", F.col("model").alias("series"), F.col("predicted").alias("value"))
            .unionByName(actual.select("datetime", F.lit("Actual").alias("series"), F.col("actual").alias("value"))))


def find_model(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Metrics row of each requested model, falling back to the best model when absent."""
    spark = metrics.sparkSession
    req = spark.createDataFrame([(n,) for n in names], "requested string")
    hit = req.join(F.broadcast(metrics), req.requested == metrics.model, "left")
    cols = ["model", "MAE", "RMSE", "R2", "MAPE"]
    return hit.select("requested", *[F.coalesce(F.col(c), best_value(metrics, c)).alias(c) for c in cols])


def residual_summary(preds: DataFrame) -> DataFrame:
    return stats.residual_summary(preds)


def residual_histogram(preds: DataFrame, bins: int = 15) -> DataFrame:
    r = preds.select("model", (F.col("actual") - F.col("predicted")).alias("residual"))
    return stats.equal_width_histogram(r, "residual", bins, ["model"], few_groups=True)


def residual_kde(preds: DataFrame, grid: int = 200) -> DataFrame:
    """Gaussian KDE of residuals per model on ``grid`` points from min to max.

    Bandwidth is Scott's rule (sample std x n^(-1/5)). One pass adds each row to
    ``grid`` running sums per model, combined map-side; rows are never copied.
    """
    r = preds.select("model", (F.col("actual") - F.col("predicted")).alias("x"))
    lim = r.groupBy("model").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"),
                                 F.stddev_samp("x").alias("sd"))
    lim = lim.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    lim = lim.withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(float(grid - 1)))
    d = r.join(F.broadcast(lim), "model")  # one row per model

    def kernel(g: int):
        z = F.try_divide(F.col("lo") + F.col("step") * F.lit(g) - F.col("x"), F.col("h"))  # zero bandwidth (all residuals equal): null density
        return F.sum(F.exp(F.lit(-0.5) * z * z))
    sums = d.groupBy("model", "lo", "step", "n", "h").agg(F.array(*[kernel(g) for g in range(grid)]).alias("_s"))
    norm = F.try_divide(F.lit(1.0), F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    return sums.select("*", F.posexplode("_s").alias("grid_index", "_k")).select(
        "model", "grid_index", (F.col("lo") + F.col("step") * F.col("grid_index")).alias("x"), (F.col("_k") * norm).alias("density"))


def residual_density_2d(preds: DataFrame, bins: int = 20) -> DataFrame:
    """Counts of (predicted, residual) on a bins x bins grid per model (non-empty cells)."""
    d = preds.select("model", F.col("predicted").alias("p"), (F.col("actual") - F.col("predicted")).alias("r"))
    lim = d.groupBy("model").agg(F.min("p").alias("plo"), F.max("p").alias("phi"),
                                 F.min("r").alias("rlo"), F.max("r").alias("rhi"), F.count(F.lit(1)).alias("n"))
    j = d.join(F.broadcast(lim), "model")

    def cell(v, lo, hi):
        w = (F.col(hi) - F.col(lo)) / F.lit(float(bins))
        return F.when(w == 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col(v) - F.col(lo)) / w), F.lit(bins - 1))).cast("int")
    g = j.groupBy("model", "n", cell("p", "plo", "phi").alias("ix"), cell("r", "rlo", "rhi").alias("iy")).agg(
        F.count(F.lit(1)).alias("count"))
    return g.select("model", "ix", "iy", "count", (F.col("count") / F.col("n")).alias("share"))


# The masses (in hundredths) that lie outside six evenly spaced contours, from 5 up to 100.
DENSITY_MASSES = (5, 24, 43, 62, 81, 100)


def residual_density_levels(preds: DataFrame, bins: int = 20, masses: Sequence[int] = DENSITY_MASSES) -> DataFrame:
    """Contour levels of the (predicted, residual) grid per model: (model, level, mass, min_count, cells, share).

    Cells in falling order of their counts are summed up; the level of a mass is
    the count of the first cell at which all but that share of the rows is
    covered. ``cells`` and ``share`` are what lies on or above the level. The
    grid table has at most bins x bins rows per model.
    """
    cells = residual_density_2d(preds, bins)
    order = Window.partitionBy("model").orderBy(F.col("count").desc(), "ix", "iy").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.select("model", "count", F.sum("count").over(order).alias("covered"), F.sum("count").over(Window.partitionBy("model")).alias("n"))
    wanted = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(m).alias("mass")) for i, m in enumerate(masses)])
    level = (ranked.select("*", F.explode(wanted).alias("w")).where(F.col("covered") * 100 >= F.col("n") * (100 - F.col("w.mass")))
             .groupBy("model", "w.level", "w.mass").agg(F.max("count").alias("min_count")))
    above = level.join(cells.select("model", "count", "share"), "model").where("count >= min_count")
    return above.groupBy("model", "level", "mass", "min_count").agg(F.count(F.lit(1)).alias("cells"), F.sum("share").alias("share"))


def align_importances(long: DataFrame, models: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per feature in the given order, one importance column per model; null where a model does not have the feature."""
    wide = long.groupBy(F.col("feature").alias("Feature")).agg(*[F.max(F.when(F.col("model") == m, F.col("importance"))).alias(m) for m in models])
    place = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("Feature"))
    return wide.withColumn("_at", place).where("_at > 0").orderBy("_at").drop("_at")


def group_limits(preds: DataFrame, q: float = 0.98, pad: float = 1.15) -> DataFrame:
    """Shared x range (predictions) and symmetric y limit (q-th percentile of |residual| x pad)."""
    absr = preds.select(F.abs(F.col("actual") - F.col("predicted")).alias("a"))
    ylim = stats.exact_percentile(absr, "a", q) * pad
    return preds.agg(F.min("predicted").alias("x_min"), F.max("predicted").alias("x_max")).withColumn(
        "y_lim", F.lit(ylim))
