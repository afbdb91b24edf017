"""Batched boosting against a plain row-by-row reference, whatever the partitions."""

import numpy as np
import pyarrow as pa
import pytest

from voltcast.operators import boosting as B

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 12, 240), rng.integers(0, 5, 240), rng.normal(size=240).round(1)], axis=1)
    y = np.round(8 * (x[:, 0] > 6) + 5 * (x[:, 1] == 2) * (x[:, 0] > 3) + 3 * x[:, 2] + rng.integers(0, 3, 240), 1)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "row long, a double, b double, c double, load double")
    return df, x, y


def shrunk(g, l1):
    return np.sign(g) * max(abs(g) - l1, 0)


def brute_tree(x, grad, depth, p, edges):
    """(feature, threshold, gain, left, right) or a leaf value, by trying every split of every node."""
    score = lambda g: shrunk(g.sum(), p.l1) ** 2 / (len(g) + p.l2)
    best = None
    if depth:
        for f in range(x.shape[1]):
            for cut in edges[f]:
                left = x[:, f] <= cut
                if min(left.sum(), (~left).sum()) >= max(p.min_rows, 1):
                    gain = score(grad[left]) + score(grad[~left]) - score(grad)
                    if gain > 1e-6 and (best is None or gain > best[2] * (1 + 1e-5)):
                        best = (f, cut, gain, left)
    if best is None:
        return -p.rate * shrunk(grad.sum(), p.l1) / (len(grad) + p.l2)
    f, cut, gain, left = best
    return f, cut, gain, brute_tree(x[left], grad[left], depth - 1, p, edges), brute_tree(x[~left], grad[~left], depth - 1, p, edges)


def apply(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] <= tree[1] else tree[4]
    return tree


def as_nested(model, t, node=0):
    tree = model.trees[t]
    f = tree["feature"][node]
    if f < 0:
        return tree["value"][node]
    return (int(f), model.edges[f][tree["cut"][node]], tree["gain"][node], as_nested(model, t, tree["left"][node]), as_nested(model, t, tree["left"][node] + 1))


def same(a, b):
    if not isinstance(a, tuple) or not isinstance(b, tuple):
        return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b, abs=1e-4)
    return a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4) and same(a[3], b[3]) and same(a[4], b[4])


@pytest.mark.parametrize("depth,l1,l2,min_rows", [(1, 0.0, 0.0, 1), (2, 0.0, 1.0, 1), (2, 20.0, 3.0, 10), (4, 0.5, 1.0, 5)])
def test_trees_equal_the_brute_force_split_table(data, depth, l1, l2, min_rows):
    df, x, y = data
    p = B.Params(rounds=3, depth=depth, rate=0.3, l1=l1, l2=l2, min_rows=min_rows, columns=1.0, rows=1.0)
    model = B.fit_many(df, [B.Spec(("m",), p, (0, 240))], FEATURES, "load", "row")[("m",)]
    assert model.base == pytest.approx(y.mean())
    predicted = np.full(240, model.base)
    for t in range(3):
        want = brute_tree(x, predicted - y, depth, p, model.edges)
        assert same(as_nested(model, t), want)
        predicted = predicted + np.array([apply(want, r) for r in x])
    got = {r.row: r.prediction for r in model.predict(df.select("row", *FEATURES)).collect()}
    np.testing.assert_allclose([got[i] for i in range(240)], predicted, atol=1e-4)


def test_partitions_and_companions_do_not_change_a_model(data, monkeypatch):
    df, _, _ = data
    specs = [B.Spec(("deep", f), B.Params(rounds=6, depth=5, rate=0.2, rows=0.8, columns=0.7), (0, 60 * f), (60 * f, 60 * f + 60)) for f in (1, 2, 3)]
    specs += [B.Spec(("leafy",), B.Params(rounds=4, depth=6, rate=0.2, leaves=5, rows=1.0, columns=1.0), (0, 240))]
    alone = B.fit_many(df, specs, FEATURES, "load", "row", runs=1)
    monkeypatch.setattr(B, "PARTITION_BYTES", 2000)
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)
    monkeypatch.setattr(B, "CELLS", 64)
    monkeypatch.setattr(B, "CHECKPOINT", 2)
    split = B.fit_many(df.repartition(7), specs, FEATURES, "load", "row", runs=3)
    for name, model in alone.items():
        other = split[name]
        assert len(model.trees) == len(other.trees) and all(same(as_nested(model, t), as_nested(other, t)) for t in range(len(model.trees)))
        assert [e["mae"] for e in model.errors] == pytest.approx([e["mae"] for e in other.errors], rel=1e-4)


def best_first(x, grad, p, edges):
    """Leaves of best-first growth: row sets, by splitting the open leaf of the highest gain."""
    leaves = [np.arange(len(x))]
    while len(leaves) < p.leaves:
        options = []
        for i, own in enumerate(leaves):
            t = brute_tree(x[own], grad[own], 1, p, edges)
            if isinstance(t, tuple):
                options.append((t[2], i, t))
        if not options:
            break
        _, i, t = max(options, key=lambda o: o[0])
        left = x[leaves[i], t[0]] <= t[1]
        leaves[i:i + 1] = [leaves[i][left], leaves[i][~left]]
    return {frozenset(own.tolist()) for own in leaves}


def leaf_sets(model, x):
    bins = B._binned([pa.array(x[:, i]) for i in range(x.shape[1])], model.edges)
    node = B._descend(bins, np.zeros((len(x), 1), np.int32), model.trees[0])[:, 0]
    return {frozenset(np.flatnonzero(node == n).tolist()) for n in set(node.tolist())}


def test_leaf_wise_growth_takes_the_highest_gains_first(data):
    df, x, y = data
    for leaves in (2, 4, 7, 12):
        p = B.Params(rounds=1, depth=30, rate=1.0, leaves=leaves, l1=0.0, l2=1.0, columns=1.0, rows=1.0, min_rows=3)
        model = B.fit_many(df, [B.Spec(("m",), p, (0, 240))], FEATURES, "load", "row")[("m",)]
        got = leaf_sets(model, x)
        assert got == best_first(x, y.mean() - y, p, model.edges) and len(got) == leaves


def test_leaf_wise_and_depth_wise_trees_differ(spark):
    # nearly all there is to learn lies above 32: four leaves by gain are all there, two levels split both sides
    x = np.arange(64.0)[:, None]
    y = np.where(x[:, 0] < 32, 0.1 * (x[:, 0] >= 16), 100.0 * (x[:, 0] // 8))
    df = spark.createDataFrame([(int(a), float(a), float(b)) for a, b in zip(x[:, 0], y)], "row long, a double, load double")
    params = lambda **more: B.Params(rounds=1, rate=1.0, l1=0.0, l2=0.0, columns=1.0, rows=1.0, **more)
    got = B.fit_many(df, [B.Spec(("leaf",), params(depth=6, leaves=4), (0, 64)), B.Spec(("depth",), params(depth=2), (0, 64))], ["a"], "load", "row")
    leaf, depth = (leaf_sets(got[(k,)], x) for k in ("leaf", "depth"))
    assert len(leaf) == len(depth) == 4 and leaf != depth
    assert frozenset(range(32)) in leaf and frozenset(range(16)) in depth


def test_patience_waits_for_a_late_improvement(spark):
    # the validation rows lie on the far side of a plateau: their error falls, rises and falls again below the first dip
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 300).round(2)
    y = np.where(x > 5, 10.0, 0.0) + rng.normal(0, 3, 300)
    df = spark.createDataFrame([(i, float(v), float(w)) for i, (v, w) in enumerate(zip(x, y))], "row long, a double, load double")
    spec = lambda name, patience, rounds=60: B.Spec((name,), B.Params(rounds=rounds, depth=3, rate=0.4, l1=0.0, columns=1.0, rows=0.6, patience=patience), (0, 200), (200, 300))
    got = B.fit_many(df, [spec("none", None), spec("short", 1), spec("long", 20)], ["a"], "load", "row")
    errors = [e["mae"] for e in got[("none",)].errors]
    assert len(errors) == 61
    for name, patience in (("short", 1), ("long", 20)):
        model = got[(name,)]
        stop = next((t for t in range(len(errors)) if t - int(np.argmin(errors[:t + 1])) >= patience), 60)
        assert len(model.errors) == stop + 1
        assert [e["mae"] for e in model.errors] == pytest.approx(errors[:stop + 1], rel=1e-6)
        assert model.best_round == int(np.argmin(errors[:stop + 1])) and model.error() == pytest.approx(min(errors[:stop + 1]))
    assert got[("long",)].error() <= got[("short",)].error()
    assert got[("none",)].best_round is None and got[("none",)].error() == errors[-1]
    cut = got[("long",)]
    scored = cut.predict(df.where("row >= 200")).collect()
    assert np.mean([abs(r.load - r.prediction) for r in scored]) == pytest.approx(cut.error(), rel=1e-4)


def test_node_table_round_trip_and_split_counts(spark, data):
    from voltcast.session import scratch_path
    df, _, _ = data
    model = B.fit_many(df, [B.Spec(("m",), B.Params(rounds=8, depth=4, columns=1.0), (0, 240))], FEATURES, "load", "row")[("m",)]
    path = scratch_path(spark, "nodes")
    model.nodes(spark, "m").write.parquet(path)
    stored = spark.read.parquet(path)
    again = B.from_nodes(stored, FEATURES)
    key = lambda m: sorted((r.row, r.prediction) for r in m.predict(df).collect())
    assert key(model) == key(again)
    counts = {r.feature: (r.splits, r.gain) for r in B.split_counts(stored, [*FEATURES, "unused"]).collect()}
    want = {c: (sum(int((t["feature"] == i).sum()) for t in model.trees), sum(float(t["gain"][t["feature"] == i].sum()) for t in model.trees)) for i, c in enumerate(FEATURES)}
    assert {c: counts[c][0] for c in FEATURES} == {c: want[c][0] for c in FEATURES} and counts["unused"] == (0, 0.0)
    assert all(counts[c][1] == pytest.approx(want[c][1]) for c in FEATURES)


def test_odd_frames(data):
    df, _, _ = data
    p = B.Params(rounds=2, depth=3)
    with pytest.raises(ValueError, match="without training rows"):
        B.fit_many(df.where("false"), [B.Spec(("m",), p, (0, 240))], FEATURES, "load", "row")
    one = B.fit_many(df.where("row = 7"), [B.Spec(("m",), p, (0, 240))], FEATURES, "load", "row")[("m",)]
    assert [len(t["feature"]) for t in one.trees] == [1, 1]
    assert one.predict(df.where("false")).count() == 0
