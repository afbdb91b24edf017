"""Ordered-window operators that scale past one partition.

A plain ``Window.orderBy(ts)`` without a partition key plans
``Exchange SinglePartition``: the whole series in one task. Everything here
instead works on a dense row position and fixed-size position blocks:

* :func:`position_index` -- one global range sort (the sampled range
  partitioner splits even a key holding a third of all rows, because the sort
  key ends in a tiebreak), then per-partition row ids, a prefix sum over the
  tiny per-partition count table (one row per partition: a proven broadcast
  bound) and ``pos = offset + local index``.
* :func:`blocked_window` -- ``block = pos div B``; rows in the last ``halo``
  positions of a block are also emitted to the next block, windows run
  ``partitionBy(series, block).orderBy(pos)`` and halo copies are dropped.
  Every window partition holds at most ``B + halo`` rows whatever the skew.
* :func:`forward_fill` -- fill inside each block, carry the last non-null value
  of earlier blocks through a one-row-per-block table.

Lags and rolling frames count rows, not time, as the reference does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltcast.constants import DEFAULT_BLOCK
from voltcast.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row-in-partition
TARGET_PARTITION_BYTES = 128 * 1024 * 1024
SMALL_PARTITION_BYTES = 1024 * 1024        # data of a few MB uses the session's parallelism, smaller data fewer tasks
FIXED_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def row_width(df: DataFrame) -> Column:
    """Bytes of a row: 8 for each number or timestamp, the length of each string or binary, and 8 a row."""
    width = F.lit(8)
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 8
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
        else:
            width = width + F.lit(FIXED_WIDTH.get(kind, 8))
    return width


def sort_partitions(df: DataFrame, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Range partitions for a global sort, from the bytes that the rows really have.

    AQE can coalesce range partitions afterwards but cannot split them, so the
    count must follow the data: at least one partition per ``target_bytes``. The
    bytes are counted, not estimated: Catalyst's estimates
    multiply the sides of joins and can be off by any factor. That is one pass
    over the input, beside the one of the range sampler.
    """
    size = df.agg(F.sum(row_width(df).cast("double"))).first()[0] or 0.0
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, int(-(-size // target_bytes)), min(parallel, int(-(-size // SMALL_PARTITION_BYTES))))


def fit_input(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Input of a model fit, coalesced to ``partitions`` if given (never a shuffle, never more).

    Iterative fitters run several jobs per iteration, with a task per input
    partition: a small input gains from few, a big one from its own.
    """
    return df if partitions is None else df.coalesce(partitions)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", never_null: Sequence[str] = ()) -> DataFrame:
    """Equi-join on ``keys`` in which null keys are equal; the right side's keys are dropped.

    Keys in ``never_null`` are compared plainly, which lets Spark see that a side
    grouped by them is unique.
    """
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [left[k] == other[f"_r_{k}"] if k in never_null else left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def position_index(df: DataFrame, order_cols: Sequence[str], series_keys: Sequence[str] = (),
                   pos_col: str = "pos", per_series: bool = True, target_bytes: int = TARGET_PARTITION_BYTES) -> DataFrame:
    """Add a gapless 0-based row position in (series, order_cols) order.

    ``order_cols`` must make the order total (add a tiebreak column when the
    time column has ties), otherwise positions of tied rows are arbitrary.
    With ``per_series`` positions restart at 0 in every series (one extra
    aggregation and join on the series keys); without it they are global, which
    is all the blocked windows need: a series' rows are contiguous in the
    global order and windows partition by (series, block).
    The sorted frame is checkpointed (reliable) because it is read more than once.
    """
    keys = [*series_keys, *order_cols]
    n_parts = sort_partitions(df, target_bytes)
    ordered = (df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
               .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = materialize(ordered)
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    counts = ordered.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the sort, each of target_bytes: 100 TB has 800,000 at 128 MB.
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    out = (ordered.withColumn("_pid", pid)
           .join(F.broadcast(offsets), "_pid")
           .withColumn("_gpos", F.col("_off") + local))
    if series_keys and per_series:
        starts = out.groupBy(*series_keys).agg(F.min("_gpos").alias("_start"))
        out = same_keys(out, starts, series_keys).withColumn(pos_col, F.col("_gpos") - F.col("_start"))
        out = out.drop("_start")
    else:
        out = out.withColumn(pos_col, F.col("_gpos"))
    return out.drop("_mid", "_pid", "_off", "_gpos")


def blocked_window(df: DataFrame, build: Callable[[Window], dict[str, Column]], halo: int,
                   pos_col: str = "pos", series_keys: Sequence[str] = (),
                   block_size: int = DEFAULT_BLOCK, block_side: DataFrame | None = None) -> DataFrame:
    """Evaluate row-frame window expressions over halo blocks.

    ``build(w)`` receives ``Window.partitionBy(series, block).orderBy(pos)`` and
    returns ``{name: expression}``. Exact as long as no frame reaches further back
    than ``halo`` rows and none reaches forward past the block end.

    ``block_side`` (columns: series keys, ``_blk``, extras) is joined on the
    window's own partition key before the window, so a sort-merge join and the
    window share one exchange (AQE may broadcast it instead when it is small).
    """
    b = max(int(block_size), int(halo), 1)
    pos = F.col(pos_col)
    in_halo = (pos % F.lit(b)) >= F.lit(b - halo)
    copies = F.when(in_halo & F.lit(halo > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    ex = df.select("*", F.explode(copies).alias("_halo"))
    ex = ex.withColumn("_blk", F.floor(pos / F.lit(b)) + F.col("_halo"))
    if block_side is not None:
        ex = same_keys(ex, block_side, [*series_keys, "_blk"], "left", never_null=["_blk"])
    w = Window.partitionBy(*series_keys, "_blk").orderBy(pos_col)
    exprs = build(w)
    out = ex.select("*", *[e.alias(n) for n, e in exprs.items()])
    return out.filter(F.col("_halo") == 0).drop("_halo", "_blk")


def trailing_stats(col: str, n: int, w: Window) -> dict[str, Column]:
    """Rolling mean/std(ddof=1)/max/min over the ``n`` rows before the current one.

    Null unless all ``n`` rows exist and are non-null (pandas ``min_periods`` = n).
    """
    f = w.rowsBetween(-n, -1)
    full = F.count(col).over(f) == n
    return {
        f"roll_mean_{n}": F.when(full, F.avg(col).over(f)),
        f"roll_std_{n}": F.when(full, F.stddev_samp(col).over(f)),
        f"roll_max_{n}": F.when(full, F.max(col).over(f)),
        f"roll_min_{n}": F.when(full, F.min(col).over(f)),
    }


CARRY_RUN = 4096  # blocks whose carries one window partition works out


def block_carry(df: DataFrame, col: str, block_size: int, pos_col: str = "pos",
                series_keys: Sequence[str] = (), run: int = CARRY_RUN) -> DataFrame:
    """(series, _blk, _carry): the last non-null ``col`` in all blocks before ``_blk``.

    In two levels, so that no task sees all blocks of a series: the last value
    per block comes from a map-side partially aggregated pass; blocks are taken
    in runs of ``run``; the last value per run is carried over the runs (one row
    per run), then inside each run over its blocks.
    """
    b = max(int(block_size), 1)
    blk = F.floor(F.col(pos_col) / F.lit(b))
    last_of = lambda order, value: F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(order), F.col(value)))).getField(value)
    blocks = (df.groupBy(*series_keys, blk.alias("_blk")).agg(last_of(pos_col, col).alias("_blast"))
              .withColumn("_run", F.floor(F.col("_blk") / F.lit(run))))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = blocks.groupBy(*series_keys, "_run").agg(last_of("_blk", "_blast").alias("_rlast"))
    # the runs of a series: its blocks / run, the only rows that meet in one task
    runs = runs.select(*series_keys, "_run", F.last("_rlast", ignorenulls=True).over(before(series_keys, "_run")).alias("_rcarry"))
    inside = blocks.withColumn("_bcarry", F.last("_blast", ignorenulls=True).over(before([*series_keys, "_run"], "_blk")))
    out = same_keys(inside, runs, [*series_keys, "_run"], "left", never_null=["_run"])
    return out.select(*series_keys, "_blk", F.coalesce("_bcarry", "_rcarry").alias("_carry"))


def fill_expr(col: str, w: Window) -> Column:
    """Last non-null value up to the current row inside a (halo) block partition."""
    return F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def forward_fill(df: DataFrame, col: str, pos_col: str = "pos", series_keys: Sequence[str] = (),
                 block_size: int = DEFAULT_BLOCK, out_col: str | None = None) -> DataFrame:
    """Carry the last non-null value forward; leading nulls stay null.

    Inside a block the window fills; earlier blocks contribute through
    :func:`block_carry`, joined on the window's partition key.
    """
    out_col = out_col or col
    carry = block_carry(df, col, block_size, pos_col, series_keys)
    out = blocked_window(df, lambda w: {"_local": fill_expr(col, w)}, halo=0, pos_col=pos_col,
                         series_keys=series_keys, block_size=block_size, block_side=carry)
    return out.withColumn(out_col, F.coalesce(F.col("_local"), F.col("_carry"))).drop("_local", "_carry")


def tail_n(df: DataFrame, n: int, pos_col: str = "pos", series_keys: Sequence[str] = ()) -> DataFrame:
    """Latest ``n`` rows per series by position; ``n <= 0`` keeps all rows.

    Uses ``pos > max(pos) - n`` (an aggregate plus a filter), not a sort.
    """
    if n <= 0:
        return df
    if series_keys:
        w = Window.partitionBy(*series_keys)
        return (df.withColumn("_maxpos", F.max(pos_col).over(w))
                .filter(F.col(pos_col) > F.col("_maxpos") - n).drop("_maxpos"))
    return df.filter(F.col(pos_col) > df.agg(F.max(pos_col)).scalar() - F.lit(n))


def lookback_sequences(df: DataFrame, value_cols: Sequence[str], label_col: str, lookback: int,
                       pos_col: str = "pos", series_keys: Sequence[str] = (),
                       block_size: int = DEFAULT_BLOCK, out_col: str = "seq") -> DataFrame:
    """Sample at row t = the ``lookback`` previous rows' values (flattened, oldest first) + label.

    Rows with fewer than ``lookback`` predecessors are dropped, as the reference's
    sequence builder starts at index ``lookback``.
    """
    vec = F.array(*[F.col(c).cast("double") for c in value_cols])

    def build(w):
        f = w.rowsBetween(-lookback, -1)
        return {"_hist": F.collect_list(vec).over(f)}

    d = blocked_window(df, build, halo=lookback, pos_col=pos_col, series_keys=series_keys,
                       block_size=block_size)
    d = d.filter(F.size("_hist") == lookback)
    return d.select(*series_keys, pos_col, F.flatten("_hist").alias(out_col),
                    F.col(label_col).alias("label"), *[c for c in d.columns if c == "datetime"])
