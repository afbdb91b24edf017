"""Adapter and feature pipeline reproduce the row counts measured in FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from voltcast.constants import FIVE_MIN, HOURLY
from voltcast.plans.features import feature_frame
from voltcast.sources import adapters

# FIXED VALUES: rows; null wdir; rows after the longest lag and the fill; of those on/after 2024-01-24
MEASURED = {
    ("hourly", "sf0.001"): (531, 350, 363, 124),
    ("hourly", "sf0.01"): (720, 39, 552, 168),
    ("5min", "sf0.01"): (5944, 4150, 3928, 1377),
}


@pytest.mark.parametrize("kind,sf", list(MEASURED))
def test_measured_counts(spark, kind, sf):
    d = f"/root/testdata/{sf}"
    raw = adapters.load_hourly(spark, d) if kind == "hourly" else adapters.load_5min(spark, d)
    cadence = HOURLY if kind == "hourly" else FIVE_MIN
    ff = feature_frame(raw, cadence, block_size=1024)
    got = (raw.count(), raw.filter(F.col("wdir").isNull()).count(), ff.count(),
           ff.filter(F.col("datetime") >= F.to_timestamp_ntz(F.lit("2024-01-24"))).count())
    assert got == MEASURED[(kind, sf)]
