"""Aggregations and statistics (single-pass where possible, partial aggregation map-side)."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regression_metrics(preds: DataFrame, group_cols: Sequence[str] = ("model",), actual: str = "actual",
                       predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE, R², MAPE (%) per group in one aggregation pass.

    R² = 1 - SSE/SST with SST = n * var_pop(actual): Spark merges the partial
    central moments of ``var_pop`` stably, so no second pass over the rows is
    needed for the mean. MAPE skips zero actuals (their count is reported as
    ``n_zero_actual``); sklearn's R² for constant y is 1.0 when perfect, else 0.0.
    """
    y, p = F.col(actual), F.col(predicted)
    err = y - p
    agg = preds.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("MAE"),
        F.sqrt(F.avg(err * err)).alias("RMSE"),
        F.sum(err * err).alias("_sse"),
        F.var_pop(y).alias("_var"),
        F.avg(F.when(y != 0, F.abs(err / y))).alias("_mape"),
        F.sum(F.when(y == 0, 1).otherwise(0)).alias("n_zero_actual"),
    )
    sst = F.col("_var") * F.col("n")
    r2 = (F.when(F.col("_var") == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - F.try_divide(F.col("_sse"), sst)))
    return agg.select(*group_cols, "n", "MAE", "RMSE", r2.alias("R2"),
                      (F.col("_mape") * 100).alias("MAPE"), "n_zero_actual")


def leaderboard(metrics: DataFrame, model_col: str = "model", digits: int = 3) -> DataFrame:
    """Round to ``digits``, rank by RMSE (ties by model name); rank 1 is the best model."""
    rounded = metrics.select(model_col, *[F.round(c, digits).alias(c) for c in ("MAE", "RMSE", "R2", "MAPE")])
    w = Window.orderBy(F.col("RMSE").asc(), F.col(model_col).asc())
    return rounded.withColumn("rank", F.row_number().over(w))


def feature_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def correlation_long(df: DataFrame, cols: Sequence[str], lower: bool = True) -> DataFrame:
    """Pearson correlation of every pair as long rows (feature_a, feature_b, corr).

    One tree-aggregated pass of MLlib's ``Correlation`` over assembled vectors
    (complete rows only, as ``corr`` on a dropna'd frame); the k x k result is a
    model-sized matrix turned into rows. ``lower`` keeps the lower triangle
    including the diagonal. A constant column gives null correlations.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    vec = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(df.select(*cols).dropna())
    m = Correlation.corr(vec, "_v", "pearson").first()[0].toArray()
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j <= i or not lower:
                v = float(m[i, j])
                rows.append((a, b, None if math.isnan(v) else v))
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")


def cv_summary(folds: DataFrame, value_col: str = "mae") -> DataFrame:
    """Mean and population standard deviation of per-fold errors."""
    return folds.agg(F.avg(value_col).alias("cv_mean_mae"), F.stddev_pop(value_col).alias("cv_std_mae"),
                     F.count(F.lit(1)).alias("n_folds"))


def residual_summary(preds: DataFrame, group_cols: Sequence[str] = ("model",), k: float = 2.5) -> DataFrame:
    """Mean, population variance and % of residuals further than k sd from the mean."""
    r = F.col("actual") - F.col("predicted")
    base = preds.select(*group_cols, r.alias("residual"))
    mom = base.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean_residual"),
                                        F.var_pop("residual").alias("var_residual"))
    # one row per group (model): a dozen or so, never the size of the data
    d = base.join(F.broadcast(mom), list(group_cols))
    out = d.groupBy(*group_cols, "n", "mean_residual", "var_residual").agg(
        (F.avg(F.when(F.abs(F.col("residual") - F.col("mean_residual"))
                      > F.lit(k) * F.sqrt(F.col("var_residual")), 1.0).otherwise(0.0)) * 100)
        .alias("outlier_pct"))
    return out


def equal_width_histogram(df: DataFrame, value_col: str, bins: int,
                          group_cols: Sequence[str] = (), few_groups: bool = False) -> DataFrame:
    """Equal-width bins from min to max per group; the last bin is closed; centres reported.

    Empty bins are reported with count 0 (bin ids generated from ``sequence``).
    Zero width (all values equal) puts every value in bin 0. The limits table has
    one row per group and is joined back on the group key; ``few_groups`` says
    that the groups are few whatever the data (models), so it is broadcast.
    """
    keys = list(group_cols) or ["_g"]
    if not group_cols:
        df = df.withColumn("_g", F.lit(0))
    v = F.col(value_col)
    lim = df.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(v - F.col("_lo"), width)), F.lit(bins - 1)))
    d = df.join(F.broadcast(lim) if few_groups or not group_cols else lim, keys)
    counts = d.groupBy(*keys, idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = lim.select(*keys, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, [*keys, "bin"], "left")
    return out.select(*group_cols, "bin", (F.col("_lo") + width * F.col("bin")).alias("bin_lo"),
                      (F.col("_lo") + width * (F.col("bin") + 1)).alias("bin_hi"),
                      (F.col("_lo") + width * (F.col("bin") + F.lit(0.5))).alias("center"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def running_min(df: DataFrame, value_col: str, order_col: str, group_cols: Sequence[str] = (),
                out_col: str = "running_min") -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out_col, F.min(value_col).over(w))


def best_of_history(df: DataFrame, value_col: str, order_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Arg-min (first on ties) and the minimum value per group."""
    key = F.struct(F.col(value_col), F.col(order_col))
    return df.groupBy(*group_cols).agg(F.min(key).getField(order_col).alias(f"best_{order_col}"),
                                       F.min(value_col).alias(f"best_{value_col}"),
                                       F.count(F.lit(1)).alias("n"))


def exact_percentile(df: DataFrame, col: str, q: float, accuracy: int = 100_000) -> float:
    """Exact percentile with linear interpolation (NumPy's default), without one task holding a column.

    1. ``percentile_approx`` brackets the target rank (rank error at most
    n/accuracy), 2. rows below the bracket are counted, 3. only the bracket
    (about 4n/accuracy rows, or as many as are tied there) is ranked, by a
    distributed sort. Falls back to the whole column when the bracket misses
    (cannot happen within the bound).
    """
    from voltcast.operators.ordered import position_index

    vals = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n = vals.count()
    if n == 0:
        return float("nan")
    rank = q * (n - 1)
    k0 = int(math.floor(rank))
    frac = rank - k0
    eps = 2.0 / accuracy
    lo_q, hi_q = max(0.0, q - eps), min(1.0, q + eps)
    lo, hi = vals.agg(F.percentile_approx("v", [lo_q, hi_q], accuracy)).first()[0]
    below = vals.filter(F.col("v") < lo).count()
    bracket = vals.filter((F.col("v") >= lo) & (F.col("v") <= hi))
    nb = bracket.count()
    if not (below <= k0 and below + nb >= min(n, k0 + 2)):
        below, bracket = 0, vals
    ranked = position_index(bracket.withColumn("_t", F.monotonically_increasing_id()), ["v", "_t"])
    want = [k0 - below, min(k0 + 1, n - 1) - below]
    got = dict(ranked.filter(F.col("pos").isin(want)).select("pos", "v").collect())
    a, b = got[want[0]], got[want[1]]
    return float(a + (b - a) * frac)
