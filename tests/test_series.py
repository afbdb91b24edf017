"""Many series at once, appended rows, and density levels, against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltcast.constants import Cadence
from voltcast.plans import analytics as an
from voltcast.plans import append
from voltcast.plans import features as fp
from voltcast.plans import models as M

SMALL = Cadence(lags=(1, 5, 20), roll=12, seasonal=5, rows_per_day=24)


def raw(spark, sizes, seed=0):
    rng = np.random.default_rng(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for s, n in sizes.items():
        for i in range(n):
            wdir = float(rng.integers(0, 360)) if rng.random() < 0.08 else None
            load = None if rng.random() < 0.03 else float(rng.integers(100, 200))
            rows.append((s, base + dt.timedelta(hours=i), load, *map(float, rng.normal(size=5).round(3)), wdir))
    df = spark.createDataFrame(rows, "s string, datetime timestamp_ntz, load double, temp double, dwpt double, rhum double, wspd double, pres double, wdir double")
    return df.withColumn("hour", F.hour("datetime")).withColumn("month", F.month("datetime")).repartition(4)


def rows_of(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("cuts", [(5, 60, 61), (0, 100)])
def test_appended_rows_equal_the_whole_run(spark, cuts):
    data = raw(spark, {"a": 110, None: 70, "late": 15}).persist()
    base = dt.datetime(2024, 1, 1)
    whole = fp.add_row_features(fp.add_window_features(fp.with_position(data, ["s"], per_series=True), SMALL, ["s"], block_size=25, fill_col="wdir"))
    cols = ["s", "pos", "datetime", "load", "wdir_filled", "wdir_sin", "temp_x_peak", *SMALL.lag_names, *SMALL.roll_names]
    bounds = [base + dt.timedelta(hours=c) for c in cuts]
    state = append.feature_state(data.where(F.col("datetime") < F.lit(bounds[0])), SMALL, ["s"]).checkpoint()
    assert state.groupBy("s").count().agg(F.max("count")).first()[0] in (None, SMALL.halo, cuts[0])
    got = []
    for at, to in zip(bounds, [*bounds[1:], base + dt.timedelta(days=99)]):
        part, state = append.append_features(data.where((F.col("datetime") >= F.lit(at)) & (F.col("datetime") < F.lit(to))), state, SMALL, ["s"], block_size=25)
        state = state.checkpoint()
        got += rows_of(part, cols)
    assert sorted(got, key=str) == rows_of(whole.where(F.col("datetime") >= F.lit(bounds[0])), cols)
    part, after = append.append_features(data.where("false"), state, SMALL, ["s"])
    assert part.count() == 0 and rows_of(after, after.columns) == rows_of(state, after.columns)


def test_appended_rows_of_one_series(spark):
    data = raw(spark, {"only": 90}).drop("s")
    cut = dt.datetime(2024, 1, 3)
    whole = fp.engineer(data, SMALL)
    got, _ = append.append_features(data.where(F.col("datetime") >= F.lit(cut)), append.feature_state(data.where(F.col("datetime") < F.lit(cut)), SMALL), SMALL)
    cols = ["pos", "datetime", "load", "wdir_filled", *SMALL.features]
    assert rows_of(got, cols) == rows_of(whole.where(F.col("datetime") >= F.lit(cut)), cols)


def test_linear_models_of_many_series(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s, n in (("a", 60), ("b", 40), (None, 30), ("flat", 20), ("one", 1)):
        for i in range(n):
            x = rng.normal(size=3)
            x[2] = 2 * x[0] if s == "b" else x[2]                       # a singular series
            x = np.zeros(3) if s == "flat" else x
            rows.append((s, i, *map(float, x), float(5 + x @ [1, -2, 3] + rng.normal())))
    rows.append(("a", 99, 1.0, None, 1.0, 1.0))
    df = spark.createDataFrame(rows, "s string, datetime long, x double, y double, z double, load double").repartition(3)
    got = {r.s: r for r in M.linear_coefficients(df, ["x", "y", "z"], ["s"]).collect()}
    for s in ("a", "b", None, "flat", "one"):
        own = np.array([r[2:] for r in rows if r[0] == s and None not in r[2:]])
        assert got[s].n == len(own)
        predicted = own[:, :3] @ got[s].weights + got[s].intercept
        full = np.column_stack([np.ones(len(own)), own[:, :3]])
        np.testing.assert_allclose(predicted, full @ np.linalg.lstsq(full, own[:, 3], rcond=None)[0], atol=1e-7)
    test = spark.createDataFrame([("a", 200, 1.0, 2.0, 3.0, 9.0), ("unknown", 200, 1.0, 2.0, 3.0, 9.0), (None, 200, 1.0, 2.0, 3.0, 9.0)], df.schema)
    out = {r.s: r.predicted for r in M.series_linear_forecast(df, test, ["x", "y", "z"], ["s"]).collect()}
    assert out["unknown"] is None and out["a"] == pytest.approx(got["a"].intercept + np.dot(got["a"].weights, [1, 2, 3])) and out[None] is not None


def test_density_levels(spark):
    rng = np.random.default_rng(9)
    preds = [(i, m, float(a), float(b)) for m, n in (("p", 300), ("q", 7), ("flat", 4)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)) * (m != "flat"))]
    df = spark.createDataFrame(preds, "datetime long, model string, actual double, predicted double")
    got = {(r.model, r.level): (r.mass, r.min_count, r.cells, r.share) for r in an.residual_density_levels(df, 6).collect()}
    for m in ("p", "q", "flat"):
        cells = sorted((r["count"] for r in an.residual_density_2d(df, 6).where(F.col("model") == m).collect()), reverse=True)
        n = sum(cells)
        for level, mass in enumerate(an.DENSITY_MASSES):
            least = next(c for k, c in enumerate(cells) if 100 * sum(cells[:k + 1]) >= n * (100 - mass))
            above = [c for c in cells if c >= least]
            assert got[(m, level)][:3] == (mass, least, len(above)) and got[(m, level)][3] == pytest.approx(sum(above) / n)


def test_tail_of_tied_times_and_series(spark):
    df = spark.createDataFrame([(s, 1, m, k) for s in ("a", None) for m in ("p", "q") for k in range(5)], "s string, datetime long, model string, id long")
    assert {(r.s, r.model, r.id) for r in an.tail_per_model(df, 2, ["s"], tiebreak="id").collect()} == {(s, m, k) for s in ("a", None) for m in ("p", "q") for k in (0, 1)}
