import numpy as np
import pytest

from voltcast.operators import boosting as B
from voltcast.operators import forest

FEATS = ["a", "b", "c"]


def table(spark, n, parts, seed=3):
    rng = np.random.RandomState(seed)
    a, b, c = rng.randint(0, 12, n), rng.randint(0, 9, n), rng.randint(0, 5, n)
    y = 3.0 * a + 10.0 * (b > 4) * c + rng.normal(0, 1, n)
    return spark.createDataFrame([(i, float(p), float(q), float(r), float(v)) for i, (p, q, r, v) in enumerate(zip(a, b, c, y))],
                                 "pos long, a double, b double, c double, y double").repartition(parts)


def row_by_row(x, w, y, depth, min_rows):
    """Every split of every feature tried: the mean that each row gets, and the decrease of squared error by feature."""
    out, gains = np.zeros(len(x)), np.zeros(x.shape[1])

    def grow(own, depth):
        n, s = w[own].sum(), (w[own] * y[own]).sum()
        best = (1e-6, None)
        if depth and n >= 2 * min_rows:
            for f in range(x.shape[1]):
                for cut in np.unique(x[own, f])[:-1]:
                    left = x[own, f] <= cut
                    nl, sl = w[own][left].sum(), (w[own][left] * y[own][left]).sum()
                    if nl >= min_rows and n - nl >= min_rows:
                        gain = sl * sl / nl + (s - sl) ** 2 / (n - nl) - s * s / n
                        if gain > best[0] * (1 + 1e-5):
                            best = (gain, (f, left))
        if best[1] is None:
            out[own] = s / n
            return
        f, left = best[1]
        gains[f] += best[0]
        grow(own[left], depth - 1)
        grow(own[~left], depth - 1)

    grow(np.flatnonzero(w), depth)
    return out, gains


def test_trees_are_those_of_a_search_of_all_splits(spark):
    df = table(spark, 300, 2)
    p = forest.Params(trees=3, depth=4, min_rows=4)
    got = forest.fit(df, p, FEATS, "y", "pos")
    rows = df.orderBy("pos").toPandas()
    x, y = rows[FEATS].to_numpy(), rows["y"].to_numpy()
    shares = np.zeros(3)
    for t in range(p.trees):
        w = forest.drawn(rows["pos"].to_numpy(), p.seed, t)
        want, gains = row_by_row(x, w, y, p.depth, p.min_rows)
        tree = got.ensemble.trees[t]
        bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(got.ensemble.edges)], axis=1).astype(np.uint8)
        at = B._descend(bins, np.zeros((len(x), 1), np.int32), tree)[:, 0]
        held = w > 0
        assert np.allclose(tree["value"][at][held] * p.trees, want[held])
        shares += gains / gains.sum()
    assert np.allclose(got.importances, shares / shares.sum())


def test_neither_partitions_nor_the_size_grown_in_one_task_change_the_forest(spark, monkeypatch):
    p = forest.Params(trees=4, depth=7, min_rows=4)
    df = table(spark, 600, 1)
    want = forest.fit(df, p, FEATS, "y", "pos")
    scored = lambda f: [r.prediction for r in f.predict(df).orderBy("pos").collect()]
    monkeypatch.setattr(B, "PARTITION_BYTES", 4000)       # many partitions
    other = forest.fit(table(spark, 600, 3), p, FEATS, "y", "pos")
    assert np.allclose(scored(other), scored(want)) and np.allclose(other.importances, want.importances)
    for most in (40, 150):                                # upper levels by sums over partitions
        monkeypatch.setattr(forest, "LOCAL_ROWS", most)
        other = forest.fit(df, p, FEATS, "y", "pos")
        assert np.allclose(scored(other), scored(want)) and np.allclose(other.importances, want.importances)
        assert [len(t["feature"]) for t in other.ensemble.trees] == [len(t["feature"]) for t in want.ensemble.trees]


def test_no_task_gets_more_rows_than_bounded(spark, monkeypatch):
    calls, large = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    real = forest._subtree

    def counted(x, weight, *rest):
        calls.add(1)
        large.add(int(weight.sum() > 60))
        return real(x, weight, *rest)

    monkeypatch.setattr(forest, "LOCAL_ROWS", 60)
    monkeypatch.setattr(forest, "_subtree", counted)
    forest.fit(table(spark, 500, 2), forest.Params(trees=2, depth=8), FEATS, "y", "pos")
    assert calls.value > 2 and large.value == 0


def test_odd_input(spark):
    p = forest.Params(trees=2, depth=3)
    flat = spark.createDataFrame([(i, 1.0, 2.0, 3.0, 5.0) for i in range(20)], "pos long, a double, b double, c double, y double")
    got = forest.fit(flat, p, FEATS, "y", "pos")
    assert [r.prediction for r in got.predict(flat).collect()] == [5.0] * 20 and got.importances.tolist() == [0.0] * 3
    one = forest.fit(flat.limit(1), p, FEATS, "y", "pos")  # a draw may hold no row at all
    assert one.predict(flat).first().prediction == pytest.approx(5.0)
    with pytest.raises(ValueError):
        forest.fit(flat.limit(0), p, FEATS, "y", "pos")


def test_draws_are_poisson():
    w = forest.drawn(np.arange(100_000), 42, 7)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert abs(np.corrcoef(w, forest.drawn(np.arange(100_000), 42, 8))[0, 1]) < 0.02
