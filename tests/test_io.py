import os

import pytest
from pyspark.sql import functions as F

from voltcast.plans import sinks
from voltcast.plans.features import feature_frame, require_columns
from voltcast.constants import HOURLY
from voltcast.session import scratch_path
from voltcast.sources import readers

HEADER = ",  datetime ,Power demand ,temp,dwpt,rhum,wdir,wspd,pres,year,month,day,hour,minute,moving_avg_3\n"


def _write_csv(tmp_path):
    lines = [HEADER]
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    order = list(range(40))
    order = order[20:] + order[:20]  # unsorted
    for i in order:
        if i == 13:
            continue  # a gap
        t = base + dt.timedelta(hours=i)
        load = "" if i == 25 else ("NaN" if i == 30 else f"{100 + i}.5")
        wdir = "" if i < 3 else str(10 * i % 360)
        lines.append(f"{i},{t:%Y-%m-%d %H:%M:%S},{load},20.1,10,50,{wdir},3,1000,{t.year},{t.month},{t.day},"
                     f"{t.hour},{t.minute},\n")
    p = tmp_path / "raw.csv"
    p.write_text("".join(lines))
    return str(p)


def test_ingest_csv_repairs(spark, tmp_path):
    path = _write_csv(tmp_path)
    df = readers.read_load_csv(spark, [str(tmp_path / "missing.csv"), path])
    assert "load" in df.columns and "moving_avg_3" not in df.columns and "datetime" in df.columns
    assert dict(df.dtypes)["datetime"] == "timestamp_ntz"
    assert df.count() == 39
    ff = feature_frame(df, HOURLY, block_size=16).toPandas()
    require_columns(ff, HOURLY.features)
    assert ff["load"].notna().all()


def test_first_existing_and_strict(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    p = tmp_path / "x.csv"
    p.write_text("datetime,Power demand\n2024-01-01 00:00:00,1\n")
    with pytest.raises(KeyError):
        readers.read_load_csv(spark, str(p), strict=True)
    assert readers.read_load_csv(spark, str(p), strict=False).columns == ["datetime", "load"]


def test_require_columns_lists_missing(spark):
    df = spark.createDataFrame([(1.0,)], "temp double")
    with pytest.raises(KeyError, match="lag_12"):
        require_columns(df, ["temp", "lag_12"])


def test_config_defaults_when_absent(spark, tmp_path):
    cfg = readers.read_config(spark, str(tmp_path / "none.json")).first()
    assert cfg.w_xgb == 0.5 and cfg.w_lgbm == 0.5


def test_metrics_csv_round_trip(spark):
    board = spark.createDataFrame([("Linear Regression", 37.106, 87.702, 0.996, 0.87, 1),
                                   ("KNN", 274.47, 372.221, 0.929, 6.39, 2)],
                                  "model string, MAE double, RMSE double, R2 double, MAPE double, rank int")
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(board, path)
    files = [f for f in os.listdir(path.replace("file:", "")) if f.endswith(".csv")]
    assert len(files) == 1
    with open(os.path.join(path.replace("file:", ""), files[0]), encoding="utf-8") as fh:
        assert fh.readline().strip() == "Model,MAE,RMSE,R²,MAPE (%)"
    back = readers.read_metrics(spark, path).orderBy("RMSE").collect()
    assert [r.model for r in back] == ["Linear Regression", "KNN"] and back[0].R2 == 0.996


def test_trials_and_history_sinks(spark):
    hist = spark.createDataFrame([(1, 42.8, 42.8), (2, 43.0, 42.8)], "trial int, mae double, running_min double")
    path = scratch_path(spark, "trials")
    sinks.write_trials(hist, path)
    back = readers.read_trials(spark, path).orderBy("Trial").collect()
    assert [(r.Trial, r.Running_Min) for r in back] == [(1, 42.8), (2, 42.8)]
    ep = spark.createDataFrame([(1, 0.01, 0.0015)], "iteration int, loss double, val_loss double")
    p2 = scratch_path(spark, "epochs")
    sinks.write_fit_history(ep, p2)
    assert readers.read_epochs(spark, p2).first().Val_Loss == 0.0015


def test_report_json(spark):
    board = spark.createDataFrame([("a", 1.0, 2.0, 0.9, 1.5, 1)],
                                  "model string, MAE double, RMSE double, R2 double, MAPE double, rank int")
    imp = spark.createDataFrame([("temp", 0.3)], "Feature string, imp double")
    r = sinks.report_json(board, imp).first().report
    assert '"metrics"' in r and '"features"' in r and '"temp"' in r


def test_predictions_round_trip_with_limit(spark):
    import datetime as dt
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * i), float(i), float(i) + 0.5) for i in range(30)]
    wide = spark.createDataFrame(rows, "datetime timestamp_ntz, Actual double, `Naive Baseline` double")
    path = scratch_path(spark, "preds")
    sinks.write_predictions(wide, path)
    back = readers.read_predictions(spark, path, limit=7).orderBy("datetime").collect()
    assert [r.Actual for r in back] == [float(i) for i in range(23, 30)]
    assert readers.read_predictions(spark, path, limit=0).count() == 30


def test_feature_profile_json(spark):
    from voltcast.operators.stats import feature_profile
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "temp double, pres double")
    path = scratch_path(spark, "profile")
    sinks.write_table(feature_profile(df, ["temp", "pres"]), path, "json", small=True)
    r = spark.read.json(path).first()
    assert r.temp == 2.0 and r.pres == 3.0


def test_profile_document_computed_once(spark):
    from voltcast.operators.stats import feature_profile
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "temp double, pres double")
    path = scratch_path(spark, "means")
    calls = []

    def compute():
        calls.append(1)
        return feature_profile(df, ["temp", "pres"])
    first = readers.profile_document(spark, path, compute).first()
    again = readers.profile_document(spark, path, compute).first()
    assert first.temp == again.temp == 2.0 and len(calls) == 1


def test_missing_value_words_become_null(spark, tmp_path):
    from voltcast.sources import readers
    path = tmp_path / "raw.csv"
    words = ["NA", "N/A", "null", "None", "nan", "", " NaN ", "#N/A"]
    path.write_text("Unnamed: 0, datetime ,Power demand,temp,moving_avg_3\n" + "".join(
        f"{i},2024-01-01 00:0{i}:00,{i}.5,{w},1\n" for i, w in enumerate(words)))
    rows = readers.read_load_csv(spark, str(path)).orderBy("datetime").collect()
    assert [r.temp for r in rows] == [None] * len(words) and [r.load for r in rows] == [i + 0.5 for i in range(len(words))]


def test_profile_document_defaults_to_zero_means(spark, tmp_path):
    from voltcast.sources import readers
    row = readers.profile_document(spark, str(tmp_path / "absent.json"), columns=["a", "b"]).first()
    assert (row.a, row.b) == (0.0, 0.0) and not (tmp_path / "absent.json").exists()


def test_importances_round_trip(spark, tmp_path):
    from voltcast.plans import sinks
    from voltcast.sources import readers
    wide = spark.createDataFrame([("hour", 0.5, 0.25, 0.125), ("temp", 0.5, 0.75, 0.875)], "`Feature` string, `Random Forest` double, `XGBoost` double, `LightGBM` double")
    sinks.write_importances(wide, str(tmp_path / "imp"))
    assert sorted(map(tuple, readers.read_importances(spark, str(tmp_path / "imp")).collect())) == sorted(map(tuple, wide.collect()))


def test_predictions_are_read_oldest_first(spark, tmp_path):
    from voltcast.sources import readers
    path = tmp_path / "p.csv"
    path.write_text("datetime,Actual\n" + "".join(f"2024-01-0{d} 00:00:00,{d}\n" for d in (3, 1, 5, 2, 4)))
    assert [r.Actual for r in readers.read_predictions(spark, str(path), limit=3).collect()] == [3.0, 4.0, 5.0]


def test_report_lists_features_in_the_models_order(spark):
    import json

    from voltcast.constants import FEATURES_5MIN
    from voltcast.plans import sinks
    board = spark.createDataFrame([(1, "m", 1.0, 1.0, 1.0, 1.0)], "rank int, model string, MAE double, RMSE double, R2 double, MAPE double")
    names = [FEATURES_5MIN[5], "zzz", FEATURES_5MIN[0], "aaa"]
    imp = spark.createDataFrame([(n, 1.0) for n in names], "Feature string, x double").repartition(4)
    got = json.loads(sinks.report_json(board, imp).first()[0])
    assert [f["Feature"] for f in got["features"]] == [FEATURES_5MIN[0], FEATURES_5MIN[5], "aaa", "zzz"]


def test_no_machine_local_folder_without_a_local_master(spark, monkeypatch):
    import pytest

    from voltcast import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
    assert session.ensure_checkpoint_dir(spark)
