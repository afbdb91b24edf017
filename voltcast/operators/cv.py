"""Time-ordered cross-validation folds (expanding window).

With n rows and k folds the test blocks have size n div (k+1); the last k
blocks, oldest first, are tested in turn and each trains on every row before
its test block, so the remainder rows go to the first training set.

A row is a test row of at most one fold and a training row of all later ones, so
``test_fold`` says everything about it: folds are range conditions on one frame
(``fold_bounds``), and tables per fold come from one aggregation by
``test_fold`` (``fold_summary``) without copying rows. ``expanding_folds`` makes the
copies for callers that want them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltcast.operators.ordered import same_keys


def fold_bounds(n: int, k: int) -> list[tuple[int, int, int]]:
    """(fold, test_start, test_end_exclusive) for folds 1..k."""
    size = n // (k + 1)
    if size == 0:
        raise ValueError(f"too few rows ({n}) for {k} folds")
    base = n - k * size
    return [(f, base + (f - 1) * size, base + f * size) for f in range(1, k + 1)]


def expanding_folds(df: DataFrame, k: int, row_col: str = "row", n: int | None = None) -> DataFrame:
    """Rows repeated once per fold they belong to, with ``fold`` and ``role`` (train/test)."""
    if n is None:
        n = df.count()
    size = n // (k + 1)
    if size == 0:
        raise ValueError(f"too few rows ({n}) for {k} folds")
    base = n - k * size
    r = F.col(row_col)
    test_fold = F.when(r >= base, F.floor((r - F.lit(base)) / F.lit(size)).cast("int") + 1).otherwise(F.lit(0))
    tagged = df.withColumn("_tf", test_fold)
    # train in folds tf+1..k; test in fold tf (when tf >= 1)
    train_folds = F.when(F.col("_tf") < k, F.sequence(F.col("_tf") + 1, F.lit(k))).otherwise(
        F.array().cast("array<int>"))
    entries = F.concat(
        F.transform(train_folds, lambda f: F.struct(f.alias("fold"), F.lit("train").alias("role"))),
        F.when(F.col("_tf") >= 1, F.array(F.struct(F.col("_tf").alias("fold"), F.lit("test").alias("role"))))
        .otherwise(F.array().cast("array<struct<fold:int,role:string>>")))
    out = tagged.withColumn("_e", F.explode(entries))
    return out.select(*df.columns, F.col("_e.fold").alias("fold"), F.col("_e.role").alias("role"))


def with_test_fold(df: DataFrame, k: int, row_col: str = "row", series_keys: Sequence[str] = ()) -> DataFrame:
    """Add ``test_fold``: 1..k where the row is tested, 0 in the rows before all test blocks.

    With ``series_keys`` every series has its own folds, from its own number of
    rows; ``row_col`` counts from 0 in each. A series of k rows or fewer has no
    folds: ``test_fold`` is null.
    """
    if series_keys:
        d = same_keys(df, df.groupBy(*series_keys).agg(F.count(F.lit(1)).alias("_n")), series_keys)
        n = F.col("_n")
    else:
        d, n = df, df.agg(F.count(F.lit(1))).scalar()
    size = F.floor(n / F.lit(k + 1))
    after = F.col(row_col) - (n - F.lit(k) * size)
    fold = F.when(size > 0, F.when(after >= 0, F.floor(F.try_divide(after, size)).cast("int") + 1).otherwise(F.lit(0)))
    return d.withColumn("test_fold", fold).drop("_n")


def fold_summary(df: DataFrame, k: int, row_col: str = "row", time_col: str = "datetime", series_keys: Sequence[str] = ()) -> DataFrame:
    """(series, fold, role, n_rows, first_row, last_row, first and last time) of every fold's training and test rows.

    One aggregation by test fold; the training rows of a fold are all earlier
    blocks, summed over the k + 1 rows per series that are left.
    """
    blocks = with_test_fold(df, k, row_col, series_keys).where("test_fold is not null").groupBy(*series_keys, "test_fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(row_col).alias("first_row"), F.max(row_col).alias("last_row"),
        F.min(time_col).alias(f"first_{time_col}"), F.max(time_col).alias(f"last_{time_col}"))
    earlier = Window.partitionBy(*series_keys).orderBy("test_fold").rowsBetween(Window.unboundedPreceding, -1)
    low, high, first, last = "first_row", "last_row", f"first_{time_col}", f"last_{time_col}"
    train = blocks.select(*series_keys, F.col("test_fold").alias("fold"), F.lit("train").alias("role"), F.sum("n_rows").over(earlier).alias("n_rows"),
                          F.min(low).over(earlier).alias(low), F.max(high).over(earlier).alias(high),
                          F.min(first).over(earlier).alias(first), F.max(last).over(earlier).alias(last))
    test = blocks.select(*series_keys, F.col("test_fold").alias("fold"), F.lit("test").alias("role"), "n_rows", low, high, first, last)
    return train.unionByName(test).where("fold > 0")
