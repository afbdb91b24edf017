import datetime as dt
import math

from voltcast.functions.features import (add_calendar, add_cyclical, add_interactions, add_wind, drop_incomplete)


def test_calendar_flags(spark):
    # 2024-01-01 is a Monday; 2024-01-06 a Saturday
    rows = [(dt.datetime(2024, 1, 1, 18, 0), 20.0), (dt.datetime(2024, 1, 6, 5, 55), 10.0),
            (dt.datetime(2024, 1, 7, 21, 59), 5.0), (dt.datetime(2024, 1, 2, 22, 0), 1.0)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, temp double")
    got = add_interactions(add_calendar(df)).orderBy("datetime").collect()
    assert [r.weekday for r in got] == [0, 1, 5, 6]
    assert [r.weekend for r in got] == [0, 0, 1, 1]
    assert [r.is_peak_hour for r in got] == [1, 0, 0, 1]
    assert [r.is_day for r in got] == [1, 0, 0, 0]
    assert got[0].temp_hour == 20.0 * 18 and got[0].temp_x_peak == 20.0


def test_cyclical_and_wind(spark):
    df = spark.createDataFrame([(6, 3, 90.0)], "hour int, month int, wdir double")
    r = add_wind(add_cyclical(df)).first()
    assert math.isclose(r.hour_sin, 1.0) and abs(r.hour_cos) < 1e-12
    assert math.isclose(r.month_sin, 1.0) and math.isclose(r.wdir_sin, 1.0)


def test_drop_incomplete_treats_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (None, 3.0), (4.0, 5.0)], "a double, b double")
    assert drop_incomplete(df).count() == 2
