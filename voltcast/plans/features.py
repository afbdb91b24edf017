"""Feature engineering plan: raw load-with-weather rows -> the 24-feature frame.

Order of work follows the reference exactly (it matters):

1. position over *all* raw rows (ordered by datetime plus tiebreak)
2. forward fill ``wdir`` (leading nulls stay), then its sin/cos
3. cyclical hour/month from the raw columns, calendar flags from ``datetime``,
   interactions
4. lags and trailing rolling statistics counted in rows over the pre-drop rows
5. drop the helper columns, then drop every row with any null

The ordered steps run on halo blocks, so no step needs the series in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltcast.constants import DEFAULT_BLOCK, FIVE_MIN, TARGET, Cadence
from voltcast.functions.features import (add_calendar, add_cyclical, add_interactions, add_wind,
                                         drop_incomplete, nan_to_null)
from voltcast.operators.ordered import blocked_window, block_carry, fill_expr, position_index, trailing_stats

RAW_DROPS = ["wdir", "hour", "month", "minute", "day", "year"]


def with_position(raw: DataFrame, series_keys: Sequence[str] = (), tiebreak: Sequence[str] = (),
                  ts_col: str = "datetime", per_series: bool = False) -> DataFrame:
    """Positions for the feature windows; global ones suffice (and skip a join) with series keys."""
    return position_index(nan_to_null(raw), [ts_col, *tiebreak], series_keys, per_series=per_series)


def add_window_features(df: DataFrame, cadence: Cadence = FIVE_MIN, series_keys: Sequence[str] = (),
                        target: str = TARGET, block_size: int = DEFAULT_BLOCK,
                        fill_col: str | None = None) -> DataFrame:
    """Lags and trailing rolling statistics of ``target`` (rows, not time).

    With ``fill_col`` the same window pass also forward-fills that column: the
    per-block carry table is joined on the window's partition key, so filling
    adds no data-sized shuffle.
    """
    b = max(int(block_size), cadence.halo)
    carry = block_carry(df, fill_col, b, series_keys=series_keys) if fill_col else None

    def build(w):
        exprs = {f"lag_{k}": F.lag(target, k).over(w) for k in cadence.lags}
        exprs.update(trailing_stats(target, cadence.roll, w))
        if fill_col:
            exprs["_local"] = fill_expr(fill_col, w)
        return exprs
    out = blocked_window(df, build, halo=cadence.halo, series_keys=series_keys, block_size=b, block_side=carry)
    if fill_col:
        out = out.withColumn(fill_col, F.coalesce(F.col("_local"), F.col("_carry"))).drop("_local", "_carry")
    return out


def add_row_features(df: DataFrame) -> DataFrame:
    """Wind, cyclical, calendar and interaction features of rows whose ``wdir`` is filled; raw helper columns go, ``wdir_filled`` stays."""
    df = df.withColumn("wdir_filled", F.col("wdir"))
    df = add_interactions(add_calendar(add_cyclical(add_wind(df))))
    return df.drop(*[c for c in RAW_DROPS if c in df.columns])


def engineer(raw: DataFrame, cadence: Cadence = FIVE_MIN, series_keys: Sequence[str] = (),
             tiebreak: Sequence[str] = (), block_size: int = DEFAULT_BLOCK,
             keep_pos: bool = True, keep_filled: bool = True) -> DataFrame:
    """All features, before the null drop (``pos`` = pre-drop position).

    Two data-sized shuffles: the range sort of :func:`position_index` and one
    halo-window pass that computes the fill, the lags and the rolling statistics
    together. Row-local features follow in the same stage.
    ``wdir_filled`` (the forward-filled direction) is kept for inspection unless
    ``keep_filled`` is false; the model input never uses it.
    """
    df = with_position(raw, series_keys, tiebreak)
    df = add_window_features(df, cadence, series_keys, block_size=block_size, fill_col="wdir")
    df = add_row_features(df)
    if not keep_filled:
        df = df.drop("wdir_filled")
    if not keep_pos:
        df = df.drop("pos")
    return df


def feature_frame(raw: DataFrame, cadence: Cadence = FIVE_MIN, series_keys: Sequence[str] = (),
                  tiebreak: Sequence[str] = (), block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Complete rows only: datetime, load and the cadence's 24 features (+ series keys).

    ``pos`` is the pre-drop position (kept so later steps can order cheaply);
    post-drop positions are made on demand by :func:`post_drop_position`.
    """
    df = engineer(raw, cadence, series_keys, tiebreak, block_size)
    df = drop_incomplete(df)
    cols = [*series_keys, "pos", "datetime", TARGET, *cadence.features]
    require_columns(df, cols)
    return df.select(*cols)


def post_drop_position(features: DataFrame, series_keys: Sequence[str] = (),
                       pos_col: str = "row") -> DataFrame:
    """Dense position among the complete rows (the reference resets its index after the drop)."""
    return position_index(features, ["pos"], series_keys, pos_col=pos_col)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"Missing features: {missing}")


def chrono_split(df: DataFrame, split_date: str, ts_col: str = "datetime") -> DataFrame:
    """Add ``split`` = 'train' before the date, 'test' from it on."""
    ts = F.col(ts_col)
    cut = F.to_timestamp_ntz(F.lit(split_date))
    return df.withColumn("split", F.when(ts < cut, F.lit("train")).otherwise(F.lit("test")))


def train_test(df: DataFrame, split_date: str, ts_col: str = "datetime") -> tuple[DataFrame, DataFrame]:
    cut = F.to_timestamp_ntz(F.lit(split_date))
    return df.filter(F.col(ts_col) < cut), df.filter(F.col(ts_col) >= cut)
