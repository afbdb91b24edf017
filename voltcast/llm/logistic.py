"""Logistic regression on all labelled rows: the rows, and Newton steps whose sums are taken where the rows lie."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW = 50_000                    # values that the driver sorts to pick one


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def newton(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 25, free: int | None = None) -> np.ndarray:
    """Weights that minimise mean logistic loss + l2/2 |w|^2; column ``free`` (an intercept) has no penalty."""
    def sums(w):
        return gradient_sums(x, y, w)

    return newton_over(sums, x.shape[1], l2, steps, free)


def gradient_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of rows, gradient and Hessian of the summed loss, side by side."""
    p = sigmoid(x @ w)
    return np.concatenate([[len(y)], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


def newton_over(sums: Callable[[np.ndarray], np.ndarray], width: int, l2: float, steps: int = 25, free: int | None = None) -> np.ndarray:
    """``newton`` on rows that only ``sums`` sees: it returns what ``gradient_sums`` does, over all of them."""
    w = np.zeros(width)
    penalty = np.full(width, l2)
    if free is not None:
        penalty[free] = 1e-9
    for _ in range(steps):
        total = sums(w)
        g = total[1:width + 1] / total[0] + penalty * w
        h = total[width + 1:].reshape(width, width) / total[0] + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def summed(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of a short array that ``of`` makes of each batch; one array a partition reaches the driver."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                total = of(batch) if total is None else total + of(batch)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return np.sum([r.s for r in sorted(rows.mapInArrow(run, "s array<double>").collect())], axis=0)


def _ranked(values: DataFrame, rank: int, n: int) -> float:
    """The value of a 0-based rank of column v, found by counting in ever narrower bins."""
    while True:
        if n <= FEW:
            return float(np.sort([r.v for r in values.select("v").collect()])[rank])
        low, high = values.agg(F.min("v"), F.max("v")).first()
        if low == high:
            return float(low)
        binned = values.withColumn("bin", F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * 1000), F.lit(999)))
        for at, size in sorted((r.bin, r["count"]) for r in binned.groupBy("bin").count().collect()):
            if rank < size:
                break
            rank -= size
        values, n = binned.where(F.col("bin") == at).select("v"), size


def quantile(values: DataFrame, share: float) -> float:
    """The exact quantile of column v, interpolated as numpy does."""
    n = values.count()
    at = share * (n - 1)
    low = int(at)
    first = _ranked(values, low, n)
    return first if at == low else first + (_ranked(values, low + 1, n) - first) * (at - low)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column) -> DataFrame:
    """(key, t, y) of all labelled training rows.

    Null keys or labels are left out, and a key that labels repeat counts once
    (its largest label). A key that documents repeat keeps its smallest text.
    """
    chosen = (labels.where(train & F.col(key).isNotNull() & F.col(label).isNotNull())
              .groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y")))
    return (docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
            .join(chosen, "k").groupBy("k").agg(F.min("t").alias("t"), F.max("y").alias("y")))
