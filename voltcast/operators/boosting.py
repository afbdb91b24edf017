"""Second-order boosted trees, many models in one run.

Models that differ in parameters and training rows (the trials and folds of a
search) are grown together. Features are binned once; a row is its bins, its
label and one running prediction per model. A round grows one tree per model,
level by level: one pass over the rows sums the gradients by (model, node,
feature, bin), the sums are merged by node across partitions, each node's best split
is found where its sums meet, and only the splits come to the driver. The next
round's first pass adds the finished trees to the predictions and takes the
validation errors of every model on the way.

Squared loss: gradient = prediction - label, hessian 1. With G and H the sums of
a node, T(G) = sign(G) max(|G| - l1, 0), a leaf is -rate T(G) / (H + l2), and a split's gain is
score(left) + score(right) - score(node), score = T(G)^2 / (H + l2).

Depth-wise models split every node that gains. Leaf-wise models split the node
of the highest gain first, up to a number of leaves: nodes are still summed level by
level, and after each level a queue over all known gains settles which splits
can still be among the first; what lies below the others is never grown.

Each pass is a job of a few milliseconds on small data and there are thousands
in a row, so they run on an RDD of packed row blocks (planning a query per pass
costs ten times as much). Where all rows are one partition (``PARTITION_BYTES`` bounds
it), its sums are already the whole ones, so the passes up to the next
checkpoint follow each other in one task; the trees are the same. Predictions
are persisted anew each round and checkpointed every ``CHECKPOINT`` rounds, so
that a lost executor recomputes few rounds.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltcast.session import ensure_checkpoint_dir

BINS = 255                     # per feature; a bin is one byte
LEAST_GAIN = 1e-6
TIE = 1e-5
CHECKPOINT = 25                # rounds between two checkpoints of the predictions
BLOCK_ROWS = 65_536            # rows of a packed block
PARTITION_BYTES = 64 << 20     # packed rows and predictions of a partition
CELLS = 1 << 16                # (row, feature) entries summed at once in a task: what a core's cache holds
STRIDE = 256                   # bins of one feature in a key
ALL_ROWS = (-(1 << 62), 1 << 62)


@dataclass(frozen=True)
class Params:
    """One model's parameters. ``leaves`` makes it leaf-wise; ``patience`` needs validation rows."""

    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    leaves: int | None = None
    min_rows: int = 1
    l1: float = 0.1
    l2: float = 1.0
    columns: float = 0.8       # share of the features that a tree may use
    rows: float = 0.8          # share of the rows that a tree is grown on
    patience: int | None = None
    metric: str = "mae"        # validation error that patience looks at: mae or mse
    seed: int = 42


@dataclass(frozen=True)
class Spec:
    """A model to fit: trained on rows [first, last) of the position column, validated on ``valid`` (same form)."""

    name: tuple
    params: Params
    train: tuple[int, int]
    valid: tuple[int, int] | None = None


@dataclass
class Boosted:
    """A fitted model: its trees (node arrays, children of a split side by side), and the validation errors after each round."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[dict[str, np.ndarray]] = field(default_factory=list)
    errors: list[dict[str, float]] = field(default_factory=list)
    best_round: int | None = None

    def error(self, metric: str = "mae") -> float:
        """Validation error of the model: at its best round if it was fitted with patience, else after all rounds."""
        return self.errors[-1 if self.best_round is None else self.best_round][metric]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the prediction; rows stay in their partitions. The broadcast model is bounded by its rounds and leaves."""
        spark = df.sparkSession
        trees = self.trees if self.best_round is None else self.trees[:self.best_round]
        roots = np.cumsum([0] + [len(t["feature"]) for t in trees])[:-1].astype(np.int32)
        table = {c: np.concatenate([t[c] for t in trees] or [np.zeros(0, np.int32)]) for c in ("feature", "cut", "value")}
        table["left"] = np.concatenate([t["left"] + r for t, r in zip(trees, roots)] or [np.zeros(0, np.int32)]).astype(np.int32)
        held = spark.sparkContext.broadcast((self.edges, self.base, roots, table))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, base, roots, table = held.value
            for batch in batches:
                x = _binned([batch.column(batch.schema.get_field_index(c)) for c in features], edges)
                total = np.full(batch.num_rows, base)
                step = max(1, CELLS // max(1, len(roots)))
                for at in range(0, batch.num_rows if len(roots) else 0, step):
                    total[at:at + step] += table["value"][_descend(x[at:at + step], _at_roots(len(x[at:at + step]), roots), table)].sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], [*batch.schema.names, out])

        features = self.features
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInArrow(score, f"{schema}, `{out}` double")

    def nodes(self, spark: SparkSession, name: str) -> DataFrame:
        """The model as a table: (model, tree, node, feature, threshold, left, gain, rows, value); tree -1 holds the base value."""
        rows = [(name, -1, 0, None, None, None, None, None, float(self.base))]
        for t, tree in enumerate(self.trees if self.best_round is None else self.trees[:self.best_round]):
            for i, f in enumerate(tree["feature"].tolist()):
                inner = f >= 0
                rows.append((name, t, i, self.features[f] if inner else None, float(self.edges[f][tree["cut"][i]]) if inner else None,
                             int(tree["left"][i]) if inner else None, float(tree["gain"][i]) if inner else None, int(tree["rows"][i]),
                             None if inner else float(tree["value"][i])))
        return spark.createDataFrame(rows, "model string, tree int, node int, feature string, threshold double, left int, gain double, rows long, value double")


def from_nodes(nodes: DataFrame, features: Sequence[str]) -> Boosted:
    """A model from its node table (bounded by rounds and leaves)."""
    rows = nodes.orderBy("tree", "node").collect()
    number = {c: i for i, c in enumerate(features)}
    cuts: list[set] = [set() for _ in features]
    for r in rows:
        if r.feature is not None:
            cuts[number[r.feature]].add(r.threshold)
    edges = [np.array(sorted(c)) for c in cuts]
    out = Boosted(list(features), edges, next(r.value for r in rows if r.tree == -1))
    trees: dict[int, list] = {}
    for r in rows:
        if r.tree >= 0:
            trees.setdefault(r.tree, []).append(r)
    for t in sorted(trees):
        own = trees[t]
        out.trees.append({
            "feature": np.array([-1 if r.feature is None else number[r.feature] for r in own], np.int32),
            "cut": np.array([0 if r.feature is None else np.searchsorted(edges[number[r.feature]], r.threshold) for r in own], np.int32),
            "left": np.array([r.left or 0 for r in own], np.int32), "gain": np.array([r.gain or 0.0 for r in own]),
            "rows": np.array([r.rows for r in own], np.int64), "value": np.array([r.value or 0.0 for r in own])})
    return out


def split_counts(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """(model, feature, splits, gain): how often each model splits on each feature, and the gain of these splits; 0 for unused features."""
    used = nodes.where("feature is not null").groupBy("model", "feature").agg(F.count("*").alias("splits"), F.sum("gain").alias("gain"))
    grid = nodes.select("model").distinct().select("model", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    return grid.join(used, ["model", "feature"], "left").select("model", "feature", F.coalesce("splits", F.lit(0)).cast("long").alias("splits"),
                                                               F.coalesce("gain", F.lit(0.0)).alias("gain"))


# --------------------------------------------------------------------------- binning and packing

def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each feature's bins (the last bin is open): quantiles, in one aggregation."""
    if not 2 <= bins <= 255:
        raise ValueError("bins must be between 2 and 255")
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, 40 * bins).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q if q is not None else [], np.float64)) for q in row]


def _binned(columns: list, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of a batch: x <= edges[b] exactly where the bin is at most b."""
    n = len(columns[0]) if columns else 0
    out = np.empty((n, len(columns)), np.uint8)
    for i, (c, e) in enumerate(zip(columns, edges)):
        out[:, i] = np.searchsorted(e, c.cast(pa.float64()).to_numpy(zero_copy_only=False), side="left")
    return out


def pack(df: DataFrame, features: Sequence[str], label: str, row: str, edges: list[np.ndarray], models: int) -> tuple[RDD, int]:
    """RDD of blocks (row, label, bins), and its number of partitions, from the number of rows there are."""
    n = df.count()
    parts = max(1, -(-n * (16 + len(features) + 4 * models) // PARTITION_BYTES))
    wanted = df.select(F.col(row).cast("long"), F.col(label).cast("double"), *[F.col(f"`{c}`").cast("double") for c in features])
    wanted = wanted.coalesce(1) if parts == 1 else wanted.repartition(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(at, BLOCK_ROWS)
                data = pickle.dumps((own.column(0).to_numpy(), own.column(1).to_numpy(zero_copy_only=False), _binned(own.columns[2:], edges)), protocol=5)
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

    return wanted.mapInArrow(run, "data binary").rdd.map(lambda r: pickle.loads(r.data)), parts


# --------------------------------------------------------------------------- work on blocks, in tasks

def _descend(x: np.ndarray, node: np.ndarray, table: dict[str, np.ndarray]) -> np.ndarray:
    """Node that each row reaches from the given ones (a column per tree) on its way down."""
    while True:
        feature = table["feature"][node]
        inner = feature >= 0
        if not inner.any():
            return node
        bins = np.take_along_axis(x, np.maximum(feature, 0), axis=1)
        node = np.where(inner, table["left"][node] + (bins > table["cut"][node]), node)


def _at_roots(n: int, roots: np.ndarray) -> np.ndarray:
    return np.repeat(roots[None, :].astype(np.int32), n, axis=0)


def _share(rows: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in [0, 1) per row, which seed and round decide."""
    x = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0x632BE59BD9B4E019 + turn * 0xD1B54A32D192ED03) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def _merge(key: np.ndarray, total: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of equal keys, by key; without counts each entry counts once."""
    if not len(key):
        return key.astype(np.int64), total, np.zeros(0, np.int64)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(at, len(key))) if count is None else np.add.reduceat(count[order], at)
    return key[at].astype(np.int64), np.add.reduceat(total[order], at), counts


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    return _merge(*(np.concatenate(c) for c in zip(*parts))) if parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))


def _gradient_sums(block: tuple, node: np.ndarray, model: int, plan: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, gradient sum, rows) of one model over a block; key = ((open node of the model, feature), bin)."""
    rows, label, x, predicted = block
    width = x.shape[1] * STRIDE
    low, high = plan["opened_at"][model], plan["opened_at"][model + 1]
    place = plan["place"][node[:, model]]
    own = np.flatnonzero((place >= 0) & (rows >= plan["first"][model]) & (rows < plan["last"][model]) & (_share(rows, plan["seed"], plan["turn"]) < plan["rows"][model]))
    size = (high - low) * width
    kind = np.int32 if size < 2**31 else np.int64
    offset = np.arange(x.shape[1], dtype=kind) * STRIDE
    parts = []
    for at in range(0, len(own), max(1, CELLS // x.shape[1])):
        r = own[at:at + max(1, CELLS // x.shape[1])]
        gradient = predicted[r, model].astype(np.float64) - label[r]
        key = ((place[r] - low).astype(kind)[:, None] * width + (x[r] + offset)).ravel()
        weight = np.repeat(gradient, x.shape[1])
        if size <= 4 * len(key):
            count = np.bincount(key, minlength=size)
            held = np.flatnonzero(count)
            parts.append((held, np.bincount(key, weight, size)[held], count[held]))
        else:
            parts.append(_merge(key, weight))
    return _merged(parts)


def best_splits(key: np.ndarray, total: np.ndarray, count: np.ndarray, n_features: int, allowed: np.ndarray,
                l1: float, l2: float, min_rows: int) -> dict[str, np.ndarray]:
    """Best split of each open node of a model that has rows: place, gain, feature, cut, sums of the left side and of the node.

    ``key`` is sorted, as ``_gradient_sums`` makes it. Gains that are equal, but
    for ``TIE`` of the highest, go to the first feature and lowest cut, so that
    rounding does not choose.
    """
    run = key >> 8                                      # a node's bins of one feature
    begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    size = np.diff(np.append(begin, len(run)))
    place, feature = run[begin] // n_features, run[begin] % n_features
    sums, counts = np.cumsum(total), np.cumsum(count)
    end = begin + size - 1
    before, before_n = sums[begin] - total[begin], counts[begin] - count[begin]
    whole, whole_n = sums[end] - before, counts[end] - before_n
    left, left_n = sums - np.repeat(before, size), counts - np.repeat(before_n, size)
    right, right_n = np.repeat(whole, size) - left, np.repeat(whole_n, size) - left_n
    score = lambda g, n: np.square(np.maximum(np.abs(g) - l1, 0)) / (n + l2)
    least = max(min_rows, 1)
    valid = np.repeat(allowed[feature], size) & (left_n >= least) & (right_n >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(valid, score(left, left_n) + score(right, right_n) - np.repeat(score(whole, whole_n), size), 0.0)
    first = begin[np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))]
    top = np.maximum.reduceat(gain, first)
    at = np.flatnonzero(gain >= np.repeat(top * (1 - TIE), np.diff(np.append(first, len(run)))))
    node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(run))))[at]
    at = at[np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))]
    own = np.searchsorted(begin, at, side="right") - 1
    return {"place": place[own], "gain": gain[at], "feature": feature[own], "cut": key[at] & (STRIDE - 1), "left_total": left[at], "left_rows": left_n[at],
            "total": whole[own], "rows": whole_n[own]}


def _errors(block: tuple, a: dict) -> np.ndarray:
    """(3, models): validation rows, sum of absolute and of squared errors over a block."""
    rows, label, _, predicted = block
    own = (rows[:, None] >= a["valid_first"]) & (rows[:, None] < a["valid_last"])
    off = np.where(own, predicted - label[:, None], 0.0)
    return np.stack([own.sum(axis=0), np.abs(off).sum(axis=0), (off * off).sum(axis=0)]).astype(np.float64)


def _model_splits(sums: tuple, model: int, plan: dict) -> dict[str, np.ndarray]:
    found = best_splits(*sums, plan["n_features"], plan["allowed"][model], plan["l1"][model], plan["l2"][model], plan["min_rows"][model])
    found["place"] = found["place"] + plan["opened_at"][model]
    return found


def _joined(splits: list[dict]) -> dict[str, np.ndarray] | None:
    return {c: np.concatenate([s[c] for s in splits]) for c in splits[0]} if splits else None


def _opened_models(plan: dict) -> list[int]:
    return np.flatnonzero(np.diff(plan["opened_at"])).tolist()


def _pass(blocks: Iterator[tuple], plan: dict, errors: bool) -> Iterator[tuple]:
    """One pass over a partition: the errors if asked for, and each model's gradient sums, dealt by ranges of its open nodes."""
    total, parts = 0.0, {}
    for block in blocks:
        if errors:
            total = total + _errors(block, plan)
        node = _descend(block[2], _at_roots(len(block[0]), plan["roots"]), plan["table"])
        for model in _opened_models(plan):
            parts.setdefault(model, []).append(_gradient_sums(block, node, model, plan))
    if errors:
        yield "errors", total
    width = plan["n_features"] * STRIDE
    for model, held in parts.items():
        sums = _merged(held)
        nodes = int(plan["opened_at"][model + 1] - plan["opened_at"][model])
        groups = min(nodes, plan["groups"])
        at = np.searchsorted(sums[0] // width * groups // nodes, np.arange(groups + 1))
        for g in range(groups):
            if at[g] < at[g + 1]:
                yield (model, g), tuple(c[at[g]:at[g + 1]] for c in sums)


def _add(a, b):
    return a + b if isinstance(a, np.ndarray) else _merged([a, b])


def _advance(block: tuple, roots: np.ndarray, table: dict, keep: np.ndarray) -> tuple:
    """The block with the last trees added to the predictions of the models that go on."""
    rows, label, x, predicted = block
    return rows, label, x, (predicted[:, keep] + table["value"][_descend(x, _at_roots(len(rows), roots[keep]), table)]).astype(np.float32)


def _rounds_in_task(held: list[tuple], lock: "_Lockstep", turns: int) -> tuple["_Lockstep", list[tuple]]:
    """Some rounds over the only partition there is: what they made of the models, and the blocks after them."""
    for _ in range(turns):
        if not lock.live:
            break
        a, allowed = lock.arrays(), lock.columns()
        errors = sum((_errors(b, a) for b in held), np.zeros((3, len(lock.live))))
        nodes: list = [None] * len(held)

        def level(plan: dict, nodes: list = nodes, held: list = held) -> dict | None:
            for i, block in enumerate(held):
                nodes[i] = _descend(block[2], _at_roots(len(block[0]), plan["roots"]) if nodes[i] is None else nodes[i], plan["table"])
            found = []
            for model in _opened_models(plan):
                sums = _merged([_gradient_sums(b, n, model, plan) for b, n in zip(held, nodes)])
                if len(sums[0]):
                    found.append(_model_splits(sums, model, plan))
            return _joined(found)

        roots, table = _grow(a, lock.seed, lock.turn, allowed, level)
        keep = lock.end_round(roots, table, errors)
        held = [_advance(b, roots, table, keep) for b in held]
    return lock, held


# --------------------------------------------------------------------------- growing trees from splits

def _shrunk(total: np.ndarray, l1: np.ndarray) -> np.ndarray:
    return np.sign(total) * np.maximum(np.abs(total) - l1, 0)


def _first_splits(splits: dict[int, tuple[float, int]], root: int, leaves: int) -> set[int]:
    """The splits that best-first growth makes with so many leaves: node -> (gain, left child) are the known ones."""
    chosen: set[int] = set()
    queue = [(-splits[root][0], root)] if root in splits else []
    while queue and len(chosen) < leaves - 1:
        _, node = heapq.heappop(queue)
        chosen.add(node)
        for child in (splits[node][1], splits[node][1] + 1):
            if child in splits:
                heapq.heappush(queue, (-splits[child][0], child))
    return chosen


def _best_first(t: dict, leaves: list, known: dict, node: np.ndarray, opened: np.ndarray) -> np.ndarray:
    """Undo the splits that leaf-wise growth cannot reach; the open nodes that are left."""
    for i in node.tolist():
        k = int(t["model"][i])
        if k in known:
            known[k][i] = (float(t["gain"][i]), int(t["left"][i]))
    dead: set[int] = set()
    for k, splits in known.items():
        if len(splits) >= leaves[k]:
            for i in set(splits) - _first_splits(splits, k, leaves[k]):
                t["feature"][i] = -1
                dead.update((splits[i][1], splits[i][1] + 1))
                del splits[i]
    return np.array([i for i in opened.tolist() if i not in dead], np.int64) if dead else opened


def _grow(a: dict, seed: int, turn: int, allowed: np.ndarray, level_splits: Callable[[dict], dict | None]) -> tuple[np.ndarray, dict]:
    """Roots and node table of a round's trees, one per model; ``level_splits`` finds the best splits of the open nodes."""
    n = len(a["first"])
    t = {"feature": np.full(n, -1, np.int32), "cut": np.zeros(n, np.int32), "left": np.zeros(n, np.int32), "gain": np.zeros(n), "rows": np.zeros(n, np.int64),
         "total": np.zeros(n), "model": np.arange(n)}
    roots = np.arange(n, dtype=np.int32)
    known: dict[int, dict[int, tuple[float, int]]] = {k: {} for k in range(n) if a["leaves"][k]}
    opened, level = np.flatnonzero(a["grows"]), 0
    while len(opened):
        place = np.full(len(t["feature"]), -1, np.int64)
        place[opened] = np.arange(len(opened))
        found = level_splits({"place": place, "opened_at": np.searchsorted(t["model"][opened], np.arange(n + 1)), "roots": roots,
                              "table": {c: t[c] for c in ("feature", "cut", "left")}, "allowed": allowed, "n_features": allowed.shape[1], "seed": seed, "turn": turn,
                              "level": level, **{c: a[c] for c in ("first", "last", "valid_first", "valid_last", "rows", "l1", "l2", "min_rows")}})
        if found is None:
            break
        order = np.argsort(found["place"])
        found = {c: v[order] for c, v in found.items()}
        node = opened[found["place"]]
        t["total"][node], t["rows"][node] = found["total"], found["rows"]
        split = found["gain"] > LEAST_GAIN
        found, node = {c: v[split] for c, v in found.items()}, node[split]
        size = len(t["feature"])
        t["feature"][node], t["cut"][node], t["left"][node], t["gain"][node] = found["feature"], found["cut"], size + 2 * np.arange(len(node)), found["gain"]
        pair = lambda x, y: np.stack([x, y], axis=1).ravel()
        model = np.repeat(t["model"][node], 2)
        more = {"feature": np.full(len(model), -1, np.int32), "cut": np.zeros(len(model), np.int32), "left": np.zeros(len(model), np.int32), "gain": np.zeros(len(model)),
                "rows": pair(found["left_rows"], found["rows"] - found["left_rows"]).astype(np.int64), "total": pair(found["left_total"], found["total"] - found["left_total"]),
                "model": model}
        t = {c: np.concatenate([t[c], more[c]]) for c in t}
        level += 1
        least = a["least"] if "least" in a else np.maximum(2 * a["min_rows"], 2)
        opened = size + np.flatnonzero((level < a["depth"][model]) & (more["rows"] >= least[model]))
        if known:
            opened = _best_first(t, a["leaves"], known, node, opened)
    m = t["model"]
    t["value"] = -a["rate"][m] * _shrunk(t["total"], a["l1"][m]) / np.maximum(t["rows"] + a["l2"][m], 1e-300)
    return roots, t


def _compact(t: dict, root: int) -> dict[str, np.ndarray]:
    """One tree's own nodes, root first."""
    order, at = [root], 0
    left = {}
    while at < len(order):
        i = order[at]
        if t["feature"][i] >= 0:
            left[at] = len(order)
            order += [int(t["left"][i]), int(t["left"][i]) + 1]
        at += 1
    own = np.array(order)
    out = {c: t[c][own] for c in ("feature", "cut", "gain", "rows", "value")}
    out["left"] = np.zeros(len(own), np.int32)
    out["left"][list(left)] = list(left.values())
    return out


@dataclass
class _Lockstep:
    """Where the models of a run stand: who goes on, the validation errors, and the trees since the last hand-over."""

    specs: list[Spec]
    n_features: int
    keep_trees: bool
    live: list[int] = field(default_factory=list)
    turn: int = 0
    best: list = field(default_factory=list)
    errors: list[list] = field(default_factory=list)
    trees: list[list] = field(default_factory=list)

    def __post_init__(self):
        n = len(self.specs)
        self.live, self.best, self.errors, self.trees = list(range(n)), [None] * n, [[] for _ in range(n)], [[] for _ in range(n)]

    @property
    def seed(self) -> int:
        return self.specs[0].params.seed

    def arrays(self) -> dict:
        """Parameters of the models that go on, as arrays."""
        own = [self.specs[i] for i in self.live]
        of = lambda pick: np.array([pick(s) for s in own])
        none = (0, 0)
        return {"first": of(lambda s: s.train[0]), "last": of(lambda s: s.train[1]), "valid_first": of(lambda s: (s.valid or none)[0]), "valid_last": of(lambda s: (s.valid or none)[1]),
                **{c: np.array([getattr(s.params, c) for s in own]) for c in ("rows", "l1", "l2", "min_rows", "rate", "depth")},
                "leaves": [s.params.leaves for s in own], "grows": np.array([self.turn < s.params.rounds for s in own])}

    def columns(self) -> np.ndarray:
        """Features that each model's next tree may use."""
        out = np.zeros((len(self.live), self.n_features), bool)
        order = np.random.RandomState([self.seed, self.turn]).permutation(self.n_features)
        for k, i in enumerate(self.live):
            out[k, order[:max(1, round(self.specs[i].params.columns * self.n_features))]] = True
        return out

    def end_round(self, roots: np.ndarray, table: dict, errors: np.ndarray) -> np.ndarray:
        """Take the errors before this round and, for the models that go on, its trees; their columns."""
        stay = [k for k, i in enumerate(self.live) if self._goes_on(i, errors[:, k])]
        if self.keep_trees:
            for k in stay:
                self.trees[self.live[k]].append(_compact(table, int(roots[k])))
        self.live = [self.live[k] for k in stay]
        self.turn += 1
        return np.array(stay, np.int64)

    def _goes_on(self, i: int, errors: np.ndarray) -> bool:
        p, validated = self.specs[i].params, self.specs[i].valid is not None
        if validated:
            n, absolute, squared = errors.tolist()
            self.errors[i].append({"mae": absolute / n if n else float("nan"), "mse": squared / n if n else float("nan")})
            if self.best[i] is None or self.errors[i][-1][p.metric] < self.errors[i][self.best[i]][p.metric]:
                self.best[i] = self.turn
        return self.turn < p.rounds and not (p.patience and validated and self.turn - self.best[i] >= p.patience)


def _base_values(blocks: RDD, specs: Sequence[Spec]) -> np.ndarray:
    """Mean label of each model's training rows."""
    first, last = np.array([s.train[0] for s in specs]), np.array([s.train[1] for s in specs])

    def run(held):
        out = np.zeros((2, len(first)))
        for rows, label, _ in held:
            own = (rows[:, None] >= first) & (rows[:, None] < last)
            out += [own.sum(axis=0), np.where(own, label[:, None], 0.0).sum(axis=0)]
        yield out

    n, total = np.sum([np.zeros((2, len(first))), *blocks.mapPartitions(run).collect()], axis=0)
    if not n.all():
        raise ValueError(f"models without training rows: {[s.name for s, k in zip(specs, n) if not k]}")
    return total / n


def _round(state: RDD, lock: _Lockstep) -> tuple[np.ndarray, dict, np.ndarray]:
    """Roots and node table of a round's trees over all partitions, and the validation errors before them."""
    a = lock.arrays()
    errors = np.zeros((3, len(lock.live)))

    def level(plan: dict) -> dict | None:
        nonlocal errors
        plan["groups"], ask = 16, plan["level"] == 0
        made = state.mapPartitions(lambda blocks: _pass(blocks, plan, ask)).reduceByKey(_add)
        made = made.map(lambda kv: kv if kv[0] == "errors" else (None, _model_splits(kv[1], kv[0][0], plan))).collect()
        errors = next((v for k, v in made if k == "errors"), errors)
        return _joined([v for k, v in made if k is None])

    found = _grow(a, lock.seed, lock.turn, lock.columns(), level)
    if not a["grows"].any():
        errors = state.map(lambda b: _errors(b, a)).sum()
    return *found, errors


def _fit_run(blocks: RDD, whole: bool, specs: list[Spec], edges: list[np.ndarray], features: list[str], keep_trees: bool) -> list[Boosted]:
    """The models of one lockstep run."""
    if len({s.params.seed for s in specs}) > 1:
        raise ValueError("models of one run share a seed")
    base = _base_values(blocks, specs)
    start = base.astype(np.float32)
    lock = _Lockstep(specs, len(features), keep_trees)
    models = [Boosted(features, edges, v) for v in base.tolist()]
    state, before = blocks.map(lambda b: (*b, np.repeat(start[None, :], len(b[0]), axis=0))), None
    while lock.live:
        if whole:
            made = state.mapPartitions(lambda held, lock=lock: [_rounds_in_task(list(held), lock, CHECKPOINT)]).persist(StorageLevel.MEMORY_AND_DISK)
            made.checkpoint()
            lock = made.map(lambda x: x[0]).collect()[0]
            state, kept = made.flatMap(lambda x: x[1]), made
        else:
            kept = state = state.persist(StorageLevel.MEMORY_AND_DISK)
            if lock.turn and lock.turn % CHECKPOINT == 0:
                state.checkpoint()
            roots, table, errors = _round(state, lock)
            keep = lock.end_round(roots, table, errors)
            last = {c: table[c] for c in ("feature", "cut", "left", "value")}
            state = state.map(lambda b, roots=roots, last=last, keep=keep: _advance(b, roots, last, keep))
        for model, trees in zip(models, lock.trees):
            model.trees += trees
        lock.trees = [[] for _ in specs]
        if before is not None:
            before.unpersist()
        before = kept
    if before is not None:
        before.unpersist()
    for model, spec, errors, best in zip(models, specs, lock.errors, lock.best):
        model.errors, model.best_round = errors, best if spec.params.patience else None
    return models


def fit_many(df: DataFrame, specs: Sequence[Spec], features: Sequence[str], label: str, row: str, bins: int = BINS,
             keep_trees: bool = True, runs: int = 8) -> dict[tuple, Boosted]:
    """Fit all models of ``specs`` on the rows of ``df``; ``row`` is the position that their row ranges count.

    Models of like depth and length go into one of ``runs`` lockstep runs, which
    are submitted side by side. Empty ranges are an error.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    edges = bin_edges(df, features, bins)
    batches = _dealt(specs, runs)
    blocks, parts = pack(df, features, label, row, edges, max(map(len, batches)))
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        blocks.count()
        with ThreadPoolExecutor(max_workers=len(batches)) as pool:
            fitted = list(pool.map(lambda b: _fit_run(blocks, parts == 1, b, edges, list(features), keep_trees), batches))
    finally:
        blocks.unpersist()
    return {s.name: m for batch, models in zip(batches, fitted) for s, m in zip(batch, models)}


def _dealt(specs: Sequence[Spec], runs: int) -> list[list[Spec]]:
    """Models in runs of like depth, the deep ones in smaller runs, so that runs take about equally long."""
    order = sorted(specs, key=lambda s: (s.params.depth, s.params.rounds), reverse=True)
    cost = np.cumsum([s.params.depth ** 2 * s.params.rounds for s in order])
    number = np.minimum((cost - cost[0]) * runs // max(1, cost[-1] - cost[0] + 1), runs - 1)
    return [[s for s, k in zip(order, number) if k == r] for r in sorted(set(number.tolist()))]
