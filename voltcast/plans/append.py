"""Features of newly arrived rows without the history: a stored state stands for it.

All that the features of a new row need of the past are the last rows up to the
longest lag, the wind direction carried into them and the position of the last
row. ``feature_state`` keeps that of every series (a table of at most ``halo`` rows per
series); ``append_features`` gives the new rows' features and the next state. Both
equal what the whole history would give.

New rows must come after a series' history. Rows of a series without state begin
a new one. An empty batch leaves the state as it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltcast.constants import DEFAULT_BLOCK, FIVE_MIN, TARGET, Cadence
from voltcast.operators.ordered import same_keys
from voltcast.plans import features as fp


def _last_rows(df: DataFrame, n: int, series_keys: Sequence[str]) -> DataFrame:
    """The last ``n`` rows of each series by position, without a window over the series."""
    if series_keys:
        last = df.groupBy(*series_keys).agg(F.max("pos").alias("_last"))
        return same_keys(df, last, series_keys).where(F.col("pos") > F.col("_last") - n).drop("_last")
    return df.where(F.col("pos") > df.agg(F.max("pos")).scalar() - n)


def feature_state(history: DataFrame, cadence: Cadence = FIVE_MIN, series_keys: Sequence[str] = (), tiebreak: Sequence[str] = ()) -> DataFrame:
    """(series, pos, load, wdir) of each series' last rows; ``wdir`` is filled, so the first row brings the carry from before."""
    rows = fp.with_position(history, series_keys, tiebreak, per_series=True)
    filled = fp.add_window_features(rows, cadence, series_keys, fill_col="wdir")
    return _last_rows(filled.select(*series_keys, "pos", TARGET, "wdir"), cadence.halo, series_keys)


def append_features(new: DataFrame, state: DataFrame, cadence: Cadence = FIVE_MIN, series_keys: Sequence[str] = (),
                    tiebreak: Sequence[str] = (), block_size: int = DEFAULT_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(all features of the new rows before the null drop, the state after them).

    The frame has the columns of ``features.engineer`` with positions per series.
    """
    rows = fp.with_position(new, series_keys, tiebreak, per_series=True)
    if series_keys:
        seen = state.groupBy(*series_keys).agg(F.max("pos").alias("_seen"))
        rows = same_keys(rows, seen, series_keys, "left").withColumn("pos", F.col("pos") + F.coalesce(F.col("_seen") + 1, F.lit(0))).drop("_seen")
    else:
        rows = rows.withColumn("pos", F.col("pos") + F.coalesce(state.agg(F.max("pos")).scalar() + 1, F.lit(0)))
    both = rows.withColumn("_new", F.lit(True)).unionByName(state.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    done = fp.add_window_features(both, cadence, series_keys, block_size=block_size, fill_col="wdir")
    after = _last_rows(done.select(*series_keys, "pos", TARGET, "wdir"), cadence.halo, series_keys)
    return fp.add_row_features(done.where("_new").drop("_new")), after
