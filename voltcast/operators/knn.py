"""Exact k-nearest-neighbour regression (Euclidean, 1/distance weights) over a box index.

Comparing every test row with every train row costs |train| x |test|. Instead:

1. train rows are cut into boxes of about ``rows_per_box`` rows by median splits
   along the widest side, a level of all boxes per aggregation (a k-d tree of at
   most ``MAX_BOXES`` leaves, so its table is bounded and can be broadcast); the true
   bounds and the number of rows of each box come from one more aggregation;
2. every test row is compared with the train rows of the box it falls into (or
   the nearest ones that hold k rows together), which bounds the distance of its k-th neighbour;
3. it then visits only boxes that are nearer than that bound, box by box
   through a second join;
4. a ``row_number <= k`` per test row merges the candidates (distance, then
   train order), with a partial limit before the shuffle;
5. the weighted mean: 1/d weights, or the plain mean of the exact matches when
   any of the k has distance 0.

Pairs are never emitted as rows. A box that cannot be cut (equal points), or that holds
more rows than ``rows_per_box`` at the last level, is dealt to shards of that size by a
hash; test rows of a box likewise, so no task holds an unbounded box. Test
rows are copied once per visited box and shard, which the k-th distance bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BOXES = 1 << 14


class Boxes:
    """A k-d tree over train rows: split dimensions and values by node, and the leaves' bounds and row counts."""

    def __init__(self, depth: int, dims: int):
        self.depth = depth
        self.dim = np.zeros((1 << depth) - 1, np.int64)
        self.cut = np.full((1 << depth) - 1, np.inf)
        self.low = np.full((1 << depth, dims), np.inf)
        self.high = np.full((1 << depth, dims), -np.inf)
        self.count = np.zeros(1 << depth, np.int64)

    def leaf(self, x: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Box of each row, or its node ``levels`` down, numbered from 0 in its level."""
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for level in range(self.depth if levels is None else levels):
            at = (1 << level) - 1 + node
            node = 2 * node + (x[rows, self.dim[at]] > self.cut[at])
        return node

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of each row to anything in each box; infinite for empty boxes."""
        gap = np.maximum(np.maximum(self.low[None] - x[:, None], x[:, None] - self.high[None]), 0)
        far = np.maximum(np.abs(x[:, None] - self.low[None]), np.abs(x[:, None] - self.high[None]))
        empty = self.count == 0
        near, far = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap)), np.sqrt(np.einsum("ijk,ijk->ij", far, far))
        near[:, empty], far[:, empty] = np.inf, np.inf
        return near, far


def _at_level(vectors: DataFrame, boxes: Boxes, level: int | None) -> DataFrame:
    """``vectors`` (x first) with its box, or its node of a level."""
    held = vectors.sparkSession.sparkContext.broadcast(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.leaf(_matrix(batch.column(0)), level))], [*batch.schema.names, "box"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{kinds}, box long")


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def build_boxes(vectors: DataFrame, dims: int, rows_per_box: int) -> Boxes:
    """Boxes of the rows' ``x``; one aggregation per level and one for the bounds."""
    n = vectors.count()
    depth = min(int(math.log2(MAX_BOXES)), max(0, math.ceil(math.log2(max(1, n / rows_per_box)))))
    boxes = Boxes(depth, dims)
    x = [F.col("x")[i] for i in range(dims)]
    for level in range(depth):
        found = _at_level(vectors.select("x"), boxes, level).groupBy("box").agg(
            F.array(*[F.max(c) - F.min(c) for c in x]).alias("width"), F.array(*[F.percentile_approx(c, 0.5, 1000) for c in x]).alias("middle"))
        for r in found.collect():
            at, dim = (1 << level) - 1 + r.box, int(np.argmax(r.width))
            if r.width[dim] > 0:
                boxes.dim[at], boxes.cut[at] = dim, r.middle[dim]
    for r in _at_level(vectors.select("x"), boxes, None).groupBy("box").agg(
            F.array(*[F.min(c) for c in x]).alias("low"), F.array(*[F.max(c) for c in x]).alias("high"), F.count(F.lit(1)).alias("n")).collect():
        boxes.low[r.box], boxes.high[r.box], boxes.count[r.box] = r.low, r.high, r.n
    return boxes


def _nearest(k: int, chunk: int):
    """The k nearest train rows of each test row, for one box and shard of each side."""
    def run(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
        if train.empty or test.empty:
            return pd.DataFrame({"_key": test["_key"].iloc[:0], "d": pd.Series([], dtype="float64"),
                                 "y": pd.Series([], dtype="float64"), "o": pd.Series([], dtype="int64")})
        train = train.sort_values("o")
        xt = np.stack(train["x"].to_numpy()).astype(np.float64)
        yt = train["y"].to_numpy(dtype=np.float64)
        ot = train["o"].to_numpy(dtype=np.int64)
        xq = np.stack(test["x"].to_numpy()).astype(np.float64)
        key = test["_key"]
        kk = min(k, len(yt))
        outs = []
        for s in range(0, len(key), chunk):
            diff = xq[s:s + chunk, None, :] - xt[None, :, :]
            d = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
            # all rows up to the k-th distance, so that ties fall by train order in the end
            limit = np.partition(d, kk - 1, axis=1)[:, kk - 1]
            rows, cols = np.nonzero(d <= limit[:, None])
            order = np.lexsort((cols, d[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            first = np.searchsorted(rows, np.arange(d.shape[0]))
            keep = np.arange(len(rows)) - first[rows] < kk
            rows, cols = rows[keep], cols[keep]
            outs.append(pd.DataFrame({"_key": key.iloc[s + rows].reset_index(drop=True), "d": d[rows, cols], "y": yt[cols], "o": ot[cols]}))
        return pd.concat(outs, ignore_index=True)
    return run


def _visits(test: DataFrame, boxes: Boxes, k: int, first: bool, rows_per_box: int) -> DataFrame:
    """Test rows copied to the boxes (and train shards) they visit.

    The first time these are the fewest boxes, by greatest distance, that surely hold k rows;
    the second time, given ``bound``, all others whose least distance is not above it.
    """
    held = test.sparkSession.sparkContext.broadcast(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        shards = np.maximum(1, -(-b.count // rows_per_box))
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), 256):
                near, far = b.distances(x[at:at + 256])
                order = np.argsort(far, axis=1, kind="stable")
                held_rows = np.cumsum(b.count[order], axis=1)
                needed = np.minimum((held_rows < k).sum(axis=1), np.maximum((b.count > 0).sum() - 1, 0))
                home = np.zeros(near.shape, bool)
                np.put_along_axis(home, order, np.arange(near.shape[1])[None] <= needed[:, None], axis=1)
                home &= b.count[None] > 0
                if first:
                    visit = home
                else:
                    bound = batch.column(2).slice(at, 256).to_numpy(zero_copy_only=False)
                    # rounding may put a row at the bound a hair outside its box
                    visit = ~home & (near <= (bound * (1 + 1e-9) + 1e-12)[:, None])
                row, box = np.nonzero(visit)
                times = shards[box]
                row, box = np.repeat(row, times), np.repeat(box, times)
                shard = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(box.astype(np.int64)), pa.array(shard.astype(np.int32))],
                                                 ["x", "_key", "box", "shard"])

    kind = test.schema["_key"].dataType.simpleString()
    return test.mapInArrow(run, f"x array<double>, _key {kind}, box long, shard int")


def _candidates(train: DataFrame, visits: DataFrame, n_tb: int, k: int, chunk: int) -> DataFrame:
    """(_key, d, y, o): the nearest rows of each box and shard that a test row visits; test rows of a box go in ``n_tb`` groups."""
    visits = visits.withColumn("tb", F.pmod(F.xxhash64("_key"), F.lit(n_tb)).cast("int"))
    wanted = visits.select(F.col("box").alias("_b"), F.col("shard").alias("_s"), F.col("tb").alias("_t")).distinct()
    cells = train.join(wanted, (train["box"] == wanted["_b"]) & (train["shard"] == wanted["_s"])).select("x", "y", "o", "_b", "_s", "_t")
    kind = visits.schema["_key"].dataType.simpleString()
    return (cells.groupBy("_b", "_s", "_t").cogroup(visits.groupBy("box", "shard", "tb"))
            .applyInPandas(_nearest(k, chunk), schema=f"_key {kind}, d double, y double, o long"))


def knn_regress(train: DataFrame, test: DataFrame, feature_cols: Sequence[str], label: str,
                train_order: str, test_key: str, k: int = 10, train_block: int = 2048,
                test_block: int = 4096, chunk: int = 64) -> DataFrame:
    """Predict ``label`` for every test row; returns (test_key, predicted, n_exact).

    ``train_order`` (a LONG, unique per train row) breaks distance ties;
    ``test_key`` must be unique per test row. Boxes hold about ``train_block``
    rows; a task holds that many train rows and about ``test_block`` test rows
    of a box. Without train rows the result is empty.
    """
    vec = F.array(*[F.col(f"`{c}`").cast("double") for c in feature_cols]).alias("x")
    rows = train.select(vec, F.col(label).cast("double").alias("y"), F.col(train_order).cast("long").alias("o"))
    boxes = build_boxes(rows, len(feature_cols), train_block)
    placed = _at_level(rows, boxes, None)
    # only boxes of more rows than a shard are in the table
    large = {int(b): int(-(-boxes.count[b] // train_block)) for b in np.flatnonzero(boxes.count > train_block)}
    table = F.create_map(*[F.lit(v) for b, n in (large or {-1: 1}).items() for v in (b, n)])
    size = F.coalesce(F.element_at(table, F.col("box").cast("int")), F.lit(1))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("o"), size).cast("int"))
    queries = test.select(vec, F.col(test_key).alias("_key"))
    n_tb = max(1, math.ceil(test.count() / (test_block * max(1, int((boxes.count > 0).sum())))))
    best = Window.partitionBy("_key").orderBy("d", "o")
    near = _candidates(placed, _visits(queries, boxes, k, True, train_block), n_tb, k, chunk)
    near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
    bound = near.groupBy("_key").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("bound"))
    bounded = queries.join(bound, "_key").select("x", "_key", "bound")
    more = _candidates(placed, _visits(bounded, boxes, k, False, train_block), n_tb, k, chunk)
    top = near.unionByName(more).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    exact = F.col("d") == 0
    agg = top.groupBy("_key").agg(
        F.sum(F.when(exact, 1).otherwise(0)).alias("n_exact"),
        F.avg(F.when(exact, F.col("y"))).alias("_exact_mean"),
        F.sum(F.when(~exact, F.col("y") / F.col("d"))).alias("_num"),
        F.sum(F.when(~exact, F.lit(1.0) / F.col("d"))).alias("_den"))
    pred = F.when(F.col("n_exact") > 0, F.col("_exact_mean")).otherwise(F.col("_num") / F.col("_den"))
    return agg.select(F.col("_key").alias(test_key), pred.alias("predicted"), "n_exact")
