"""Random forests of regression trees, each grown where its rows are.

A tree is grown on a bootstrap draw: how often it holds a row is a Poisson
number that seed, tree and row position decide, so the forest does not hang on
how the rows are partitioned. Features are binned once. While a node has more
than ``LOCAL_ROWS`` rows, it is split by sums over all partitions, a level of all trees at
a time (few nodes are that large, so the sums are small). The rows of each smaller
node then meet in one task, which grows what lies below it. So every
shuffle is bounded by the drawn rows, however deep the trees are.

Splits take the largest decrease of squared error over all features; both sides
hold at least ``min_rows`` drawn rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from voltcast.operators import boosting as B
from voltcast.session import ensure_checkpoint_dir

LOCAL_ROWS = 1 << 16           # drawn rows of a node that one task grows
TASK_BYTES = 64 << 20          # drawn rows of a task's nodes
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


@dataclass(frozen=True)
class Params:
    trees: int = 150
    depth: int = 15
    min_rows: int = 4
    bins: int = 32
    seed: int = 42


@dataclass
class Forest:
    """A fitted forest: its trees, whose values add up to the mean over all trees, and each feature's share of the decrease of squared error."""

    ensemble: B.Boosted
    importances: np.ndarray

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.ensemble.predict(df, out)


def drawn(rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree holds each row."""
    return np.searchsorted(_POISSON, B._share(rows, seed, tree), side="right")


def _sums(place: np.ndarray, x: np.ndarray, weight: np.ndarray, off: np.ndarray, nodes: int, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, sum, drawn rows) by ((node, feature), bin), as ``boosting.best_splits`` takes them."""
    n_features = x.shape[1]
    size, step = nodes * n_features * bins, max(1, (B.CELLS * 16) // max(1, n_features))
    count, total = np.zeros(size), np.zeros(size)
    offset = np.arange(n_features) * bins
    for at in range(0, len(x), step):
        own = slice(at, at + step)
        key = (place[own, None] * (n_features * bins) + offset + x[own]).ravel()
        count += np.bincount(key, np.repeat(weight[own], n_features), size)
        total += np.bincount(key, np.repeat(weight[own] * off[own], n_features), size)
    held = np.flatnonzero(count)
    return held // bins * B.STRIDE + held % bins, total[held], count[held].astype(np.int64)


def _arrays(n: int, p: Params, depth: int, least: int) -> dict:
    """What ``boosting._grow`` wants of n trees: no penalties, whole steps, nodes of at least ``least`` rows opened."""
    none, full = np.zeros(n, np.int64), lambda v: np.full(n, v)
    return {"first": none, "last": none, "valid_first": none, "valid_last": none, "rows": full(1.0), "l1": full(0.0), "l2": full(0.0), "rate": full(1.0),
            "min_rows": full(p.min_rows), "depth": full(depth), "leaves": [None] * n, "grows": full(True), "least": full(max(least, 2 * p.min_rows, 2))}


def _subtree(x: np.ndarray, weight: np.ndarray, off: np.ndarray, depth: int, p: Params) -> dict[str, np.ndarray]:
    """The nodes of a tree over rows that are all here, root first; ``off`` is the base value less the label."""
    at = np.zeros(len(x), np.int64)

    def level(plan: dict) -> dict | None:
        nonlocal x, weight, off, at
        t, opened = plan["table"], plan["place"]
        if plan["level"]:
            at = t["left"][at] + (x[np.arange(len(x)), t["feature"][at]] > t["cut"][at])
        stay = opened[at] >= 0
        x, weight, off, at = x[stay], weight[stay], off[stay], at[stay]
        found = B.best_splits(*_sums(opened[at], x, weight, off, int(plan["opened_at"][-1]), p.bins), x.shape[1], plan["allowed"][0], 0.0, 0.0, p.min_rows)
        # rows of nodes that are not split go no further
        inner = np.zeros(int(plan["opened_at"][-1]), bool)
        inner[found["place"]] = found["gain"] > B.LEAST_GAIN
        stay = inner[opened[at]]
        x, weight, off, at = x[stay], weight[stay], off[stay], at[stay]
        return found

    _, t = B._grow(_arrays(1, p, depth, 0), p.seed, 0, np.ones((1, x.shape[1]), bool), level)
    return t


def _large_nodes(blocks: RDD, p: Params, n_features: int, base: float) -> tuple[np.ndarray, dict]:
    """Roots and node table of all trees down to nodes of ``LOCAL_ROWS`` rows, by sums over all partitions."""
    def level(plan: dict) -> dict | None:
        def run(held: Iterator[tuple]) -> Iterator[tuple]:
            found: dict[int, tuple] = {}
            for rows, label, x in held:
                for tree in B._opened_models(plan):
                    low, high = plan["opened_at"][tree], plan["opened_at"][tree + 1]
                    node = B._descend(x, B._at_roots(len(x), plan["roots"][tree:tree + 1]), plan["table"])[:, 0]
                    weight = drawn(rows, p.seed, tree)
                    own = np.flatnonzero((plan["place"][node] >= 0) & (weight > 0))
                    if len(own):
                        made = _sums(plan["place"][node[own]] - low, x[own], weight[own], base - label[own], int(high - low), p.bins)
                        found[tree] = B._merged([found[tree], made]) if tree in found else made
            yield from found.items()

        def best(kv: tuple) -> dict:
            found = B.best_splits(*kv[1], n_features, plan["allowed"][kv[0]], 0.0, 0.0, p.min_rows)
            return {**found, "place": found["place"] + plan["opened_at"][kv[0]]}

        return B._joined(blocks.mapPartitions(run).reduceByKey(lambda a, b: B._merged([a, b])).map(best).collect())

    return B._grow(_arrays(p.trees, p, p.depth, LOCAL_ROWS + 1), p.seed, 0, np.ones((p.trees, n_features), bool), level)


def _grafted(t: dict, below: dict[int, dict], roots: np.ndarray) -> list[dict[str, np.ndarray]]:
    """One table per tree: the upper nodes, root first, with the subtrees put where they belong."""
    trees = []
    for root in roots.tolist():
        order, left, at = [root], {}, 0
        while at < len(order):
            i = order[at]
            if t["feature"][i] >= 0:
                left[at] = len(order)
                order += [int(t["left"][i]), int(t["left"][i]) + 1]
            at += 1
        own = {c: t[c][order] for c in ("feature", "cut", "value")}
        own["left"] = np.zeros(len(order), np.int32)
        own["left"][list(left)] = list(left.values())
        parts, size = [own], len(order)
        for k, i in enumerate(order):
            if i in below:
                sub = below[i]
                # the subtree's root takes the upper leaf's place, its other nodes follow
                moved = np.where(sub["feature"] >= 0, sub["left"] + (size - 1), 0).astype(np.int32)
                for c in ("feature", "cut", "value"):
                    own[c][k] = sub[c][0]
                own["left"][k] = moved[0]
                parts.append({"feature": sub["feature"][1:], "cut": sub["cut"][1:], "value": sub["value"][1:], "left": moved[1:]})
                size += len(moved) - 1
        trees.append({c: np.concatenate([x[c] for x in parts]) for c in own})
    return trees


def fit(df: DataFrame, p: Params, features: Sequence[str], label: str, row: str) -> Forest:
    """Fit a forest on all rows of ``df``; ``row`` is their position, which the draws hang on. No rows are an error."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    edges = B.bin_edges(df, features, p.bins)
    blocks, _ = B.pack(df, features, label, row, edges, p.trees)
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    n_features = len(features)
    try:
        n, total = np.sum([np.zeros(2), *blocks.map(lambda b: np.array([len(b[0]), b[1].sum()])).collect()], axis=0)
        if not n:
            raise ValueError("a forest without training rows")
        base = float(total / n)
        if n > LOCAL_ROWS // 2:
            roots, t = _large_nodes(blocks, p, n_features, base)
        else:
            roots = np.arange(p.trees, dtype=np.int32)
            t = {"feature": np.full(p.trees, -1, np.int32), "cut": np.zeros(p.trees, np.int32), "left": np.zeros(p.trees, np.int32), "gain": np.zeros(p.trees),
                 "rows": np.full(p.trees, -1), "value": np.zeros(p.trees), "model": np.arange(p.trees)}
        depth = np.zeros(len(t["feature"]), np.int64)
        for i in np.flatnonzero(t["feature"] >= 0).tolist():
            depth[t["left"][i]] = depth[t["left"][i] + 1] = depth[i] + 1
        small = (t["rows"] < 0) | ((t["rows"] >= max(2 * p.min_rows, 2)) & (t["rows"] <= LOCAL_ROWS))
        open_ = np.flatnonzero((t["feature"] < 0) & (depth < p.depth) & small)
        number = np.full(len(t["feature"]), -1, np.int64)
        number[open_] = np.arange(len(open_))
        upper = {c: t[c] for c in ("feature", "cut", "left")}

        def deal(block: tuple) -> Iterator[tuple]:
            rows, label, x = block
            for tree, root in enumerate(roots.tolist()):
                weight = drawn(rows, p.seed, tree)
                held = np.flatnonzero(weight)
                place = number[B._descend(x[held], B._at_roots(len(held), roots[tree:tree + 1]), upper)[:, 0]]
                order = np.argsort(place, kind="stable")
                held, place = held[order], place[order]
                at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else []
                for a, b in zip(at, [*at[1:], len(place)]):
                    if place[a] >= 0:
                        own = held[a:b]
                        yield int(place[a]), pickle.dumps((rows[own], x[own], weight[own].astype(np.uint8), label[own]), protocol=5)

        def grow(kv: tuple) -> tuple:
            parts = [pickle.loads(data) for data in kv[1]]
            rows, x, weight, label = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(rows, kind="stable")  # sums do not hang on the order of arrival
            sub = _subtree(x[order], weight[order].astype(np.float64), base - label[order], p.depth - int(depth[open_[kv[0]]]), p)
            inner = sub["feature"] >= 0
            gain = np.bincount(sub["feature"][inner], sub["gain"][inner], n_features)
            slim = {"feature": sub["feature"].astype(np.int16), "cut": sub["cut"].astype(np.uint8), "left": sub["left"].astype(np.int32), "value": sub["value"]}
            return int(open_[kv[0]]), slim, gain

        tasks = max(spark.sparkContext.defaultParallelism * 2, math.ceil(n * p.trees * (n_features + 18) / TASK_BYTES))
        made = blocks.flatMap(deal).groupByKey(max(1, min(tasks, len(open_)))).map(grow).collect()
    finally:
        blocks.unpersist()
    gains = np.zeros((p.trees, n_features))
    inner = t["feature"] >= 0
    np.add.at(gains, (t["model"][inner], t["feature"][inner]), t["gain"][inner])
    for i, _, gain in made:
        gains[t["model"][i]] += gain
    whole = gains.sum(axis=1, keepdims=True)
    shares = np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0).sum(axis=0)
    trees = _grafted(t, {i: sub for i, sub, _ in made}, roots)
    for tree in trees:
        tree["value"] = (tree["value"] + base) / p.trees
    return Forest(B.Boosted(list(features), edges, 0.0, trees), shares / shares.sum() if shares.sum() else shares)
