"""Ordered windows: halo blocks must equal plain single-partition windows."""

import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from voltcast.operators.ordered import (blocked_window, forward_fill, lookback_sequences, position_index,
                                        tail_n, trailing_stats)


def _series(spark, n, null_at=(), seed=0):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=5 * i), None if i in null_at else round(rng.uniform(100, 200), 2))
            for i in range(n)]
    return spark.createDataFrame(rows, "datetime timestamp_ntz, load double")


def _pandas_features(pdf, lags, roll):
    s = pdf["load"]
    out = {f"lag_{k}": s.shift(k) for k in lags}
    sh = s.shift(1).rolling(roll)
    out.update({f"roll_mean_{roll}": sh.mean(), f"roll_std_{roll}": sh.std(),
                f"roll_max_{roll}": sh.max(), f"roll_min_{roll}": sh.min()})
    return pd.DataFrame(out)


def test_position_index_dense_and_ordered(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i // 3), i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, k long")
    got = position_index(df, ["ts", "id"]).orderBy("pos").toPandas()
    assert list(got["pos"]) == list(range(200))
    assert list(got["id"]) == sorted(got["id"], key=lambda i: (i // 3, i))


def test_position_index_per_series(spark):
    rows = [(s, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for s in ("a", "b", "c") for i in range(37)]
    df = spark.createDataFrame(rows, "s string, i long, ts timestamp_ntz")
    got = position_index(df, ["ts", "i"], series_keys=["s"]).toPandas()
    for _, g in got.groupby("s"):
        assert sorted(g["pos"]) == list(range(37))
        assert list(g.sort_values("pos")["i"]) == list(range(37))


def test_blocked_equals_plain_random(spark):
    rnd = random.Random(7)
    for trial in range(4):
        n = rnd.randint(60, 160)
        nulls = set(rnd.sample(range(n), rnd.randint(0, 6)))
        df = position_index(_series(spark, n, nulls, seed=trial), ["datetime"])
        lags, roll = (1, 5, 30), 12
        halo = max(max(lags), roll + 1)
        block = rnd.randint(halo, halo + 40)

        def build(w):
            e = {f"lag_{k}": F.lag("load", k).over(w) for k in lags}
            e.update(trailing_stats("load", roll, w))
            return e
        got = blocked_window(df, build, halo=halo, block_size=block).orderBy("pos").toPandas()
        pdf = df.orderBy("pos").toPandas()
        want = _pandas_features(pdf, lags, roll)
        for c in want.columns:
            np.testing.assert_allclose(got[c].astype(float).to_numpy(), want[c].to_numpy(), rtol=1e-9,
                                       equal_nan=True, err_msg=f"{c} trial {trial} block {block}")


def test_rolling_needs_full_window(spark):
    for n in (11, 12, 13):
        df = position_index(_series(spark, n), ["datetime"])
        got = blocked_window(df, lambda w: trailing_stats("load", 12, w), halo=13).orderBy("pos").toPandas()
        assert got["roll_mean_12"].notna().sum() == max(0, n - 12)


def test_null_inside_frame_nullifies(spark):
    df = position_index(_series(spark, 40, null_at=(5, 20)), ["datetime"])
    got = blocked_window(df, lambda w: trailing_stats("load", 12, w), halo=13).orderBy("pos").toPandas()
    valid = [p for p in range(40) if p >= 12 and not any(q in (5, 20) for q in range(p - 12, p))]
    assert sorted(got.loc[got["roll_mean_12"].notna(), "pos"]) == valid


def test_forward_fill_leading_nulls_and_blocks(spark):
    vals = [None, None, 3.0, None, None, None, 7.0, None, None, None, None, None, 11.0, None]
    rows = [(i, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "pos long, wdir double")
    got = forward_fill(df, "wdir", block_size=3).orderBy("pos").toPandas()["wdir"].tolist()
    want = pd.Series(vals, dtype=float).ffill().tolist()
    assert [None if pd.isna(x) else x for x in got] == [None if pd.isna(x) else x for x in want]


def test_tail_n(spark):
    df = spark.range(50).withColumnRenamed("id", "pos")
    assert sorted(r.pos for r in tail_n(df, 5).collect()) == [45, 46, 47, 48, 49]
    assert tail_n(df, 0).count() == 50


def test_lookback_sequences(spark):
    rows = [(i, float(i), float(10 * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "pos long, a double, load double")
    got = lookback_sequences(df, ["a", "load"], "load", 4, block_size=8).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(4, 30))
    r = got[0]
    assert r.seq == [0.0, 0.0, 1.0, 10.0, 2.0, 20.0, 3.0, 30.0] and r.label == 40.0


def test_no_single_partition_exchange_on_data(spark):
    df = position_index(_series(spark, 100), ["datetime"])
    out = blocked_window(df, lambda w: {"l": F.lag("load", 3).over(w)}, halo=3, block_size=16)
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            # only the per-partition count table (an aggregate: one row per partition) may be gathered
            assert "HashAggregate" in lines[i + 1], "\n".join(lines[i:i + 3])


def test_leakage_future_rows_do_not_change_features(spark):
    a = position_index(_series(spark, 80, seed=1), ["datetime"])
    pdf = _series(spark, 80, seed=1).toPandas()
    pdf.loc[70:, "load"] = 9999.0
    b = position_index(spark.createDataFrame(pdf, "datetime timestamp_ntz, load double"), ["datetime"])

    def build(w):
        e = {"lag_5": F.lag("load", 5).over(w)}
        e.update(trailing_stats("load", 12, w))
        return e
    fa = blocked_window(a, build, halo=13, block_size=20).filter("pos < 70").orderBy("pos").toPandas()
    fb = blocked_window(b, build, halo=13, block_size=20).filter("pos < 70").orderBy("pos").toPandas()
    pd.testing.assert_frame_equal(fa.drop(columns=["load"]), fb.drop(columns=["load"]))


def test_series_windows_on_global_positions(spark):
    rnd = random.Random(11)
    rows = []
    for s in ("a", "b", "c"):
        for i in range(rnd.randint(20, 70)):
            rows.append((s, i, None if rnd.random() < 0.05 else float(rnd.randint(1, 99))))
    df = spark.createDataFrame(rows, "s string, t long, load double")
    d = position_index(df, ["t"], ["s"], per_series=False)

    def build(w):
        e = {"lag_3": F.lag("load", 3).over(w)}
        e.update(trailing_stats("load", 5, w))
        return e
    got = blocked_window(d, build, halo=6, series_keys=["s"], block_size=16).toPandas()
    pdf = df.toPandas().sort_values(["s", "t"])
    g = pdf.groupby("s")["load"]
    pdf["lag_3"] = g.shift(3)
    pdf["roll_mean_5"] = g.transform(lambda x: x.shift(1).rolling(5).mean())
    m = got.merge(pdf, on=["s", "t"], suffixes=("", "_want"))
    assert len(m) == len(pdf)
    np.testing.assert_allclose(m["lag_3"].astype(float), m["lag_3_want"], equal_nan=True)
    np.testing.assert_allclose(m["roll_mean_5"].astype(float), m["roll_mean_5_want"], equal_nan=True)


def test_feature_pipeline_single_window_exchange(spark):
    from voltcast.constants import HOURLY
    from voltcast.plans.features import engineer
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=i), float(100 + i % 7), 20.0, 10.0, 50.0, 3.0, 1000.0,
             None if i % 5 else float(i % 360), 2024, 1, 1 + i // 24, i % 24, 0) for i in range(300)]
    raw = spark.createDataFrame(rows, "datetime timestamp_ntz, load double, temp double, dwpt double, rhum double, "
                                      "wspd double, pres double, wdir double, year int, month int, day int, hour int, "
                                      "minute int")
    lines = engineer(raw, HOURLY, block_size=64)._jdf.queryExecution().executedPlan().toString().splitlines()

    def indent(ln):
        return len(ln) - len(ln.lstrip(" :+-"))

    data_side = 0  # exchanges on (series, block) that move the rows themselves (halo Generate below them)
    for i, ln in enumerate(lines):
        if "Exchange hashpartitioning(_blk" in ln:
            below = []
            for nxt in lines[i + 1:]:
                if indent(nxt) <= indent(ln):
                    break
                below.append(nxt)
            data_side += any("Generate" in b for b in below)
    assert data_side == 1, "\n".join(lines)


def test_partition_sizing_helpers(spark):
    from voltcast.operators.ordered import fit_input, sort_partitions
    df = spark.range(1000).repartition(6)
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sort_partitions(df) == 1
    assert sort_partitions(df, target_bytes=1000) == 16  # 16 bytes a row
    assert sort_partitions(spark.range(4_000_000)) == base
    assert sort_partitions(df.where("false")) == 1
    assert fit_input(df).rdd.getNumPartitions() == 6  # its own
    assert fit_input(df, 2).rdd.getNumPartitions() == 2
    assert fit_input(df, 50).rdd.getNumPartitions() == 6  # coalesce never increases


def test_partitions_follow_rows_and_not_estimates(spark):
    from voltcast.constants import HOURLY
    from voltcast.operators.ordered import sort_partitions
    from voltcast.plans import features as fp
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=i), float(i % 50), 1.0, 2.0, 3.0, 4.0, 5.0, None if i % 3 else float(i % 360)) for i in range(600)]
    raw = spark.createDataFrame(rows, "datetime timestamp_ntz, load double, temp double, dwpt double, rhum double, wspd double, pres double, wdir double")
    features = fp.feature_frame(raw.withColumn("hour", F.hour("datetime")).withColumn("month", F.month("datetime")), HOURLY)
    lazily_cached = features.persist()
    assert sort_partitions(lazily_cached) == 1
    ranked = fp.post_drop_position(lazily_cached)
    assert ranked.rdd.getNumPartitions() == 1 and ranked.count() == lazily_cached.count() > 400
    estimate = int(str(lazily_cached.join(lazily_cached.select("pos"), "pos")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert sort_partitions(lazily_cached.join(lazily_cached.select("pos"), "pos")) == 1 < estimate // 1000


def test_carry_in_two_levels(spark):
    from voltcast.operators.ordered import block_carry
    rng = random.Random(4)
    values = [(s, p, float(p) if rng.random() < 0.04 else None) for s in ("a", None) for p in range(300)]
    df = spark.createDataFrame(values, "s string, pos long, v double").repartition(5)
    for run in (1, 3, 1000):
        got = {(r.s, r._blk): r._carry for r in block_carry(df, "v", 7, series_keys=["s"], run=run).collect()}
        for s in ("a", None):
            for blk in range(43):
                held = [v for k, p, v in values if k == s and p < 7 * blk and v is not None]
                assert got[(s, blk)] == (held[-1] if held else None)


def test_null_series_keys_are_a_series(spark):
    from pyspark.sql import functions as F

    from voltcast.operators.ordered import forward_fill, position_index
    rows = [(None, 1, 1.0), (None, 2, None), ("a", 1, None), ("a", 2, 5.0), ("a", 3, None)]
    df = position_index(spark.createDataFrame(rows, "s string, t int, v double"), ["t"], ["s"])
    assert sorted((r.s or "", r.t, r.pos) for r in df.collect()) == [("", 1, 0), ("", 2, 1), ("a", 1, 0), ("a", 2, 1), ("a", 3, 2)]
    filled = forward_fill(df, "v", series_keys=["s"], block_size=1)
    assert sorted((r.s or "", r.t, r.v) for r in filled.select("s", "t", F.coalesce("v", F.lit(-1.0)).alias("v")).collect()) == [
        ("", 1, 1.0), ("", 2, 1.0), ("a", 1, -1.0), ("a", 2, 5.0), ("a", 3, 5.0)]
