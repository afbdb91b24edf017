"""voltcast: short-term load forecasting expressed as Spark DataFrame plans.

Layout
------
sources/    readers (CSV ingest with header repairs, artefact tables, JSON documents)
            and the adapters that turn the driver's ``events`` table into load series
functions/  column expressions (calendar, cyclical, interaction features, predicates)
operators/  ordered-window machinery (position index, halo blocks), statistics,
            reshaping and time-ordered cross-validation folds
plans/      composed pipelines: feature frame, forecasters, tuning, analytics, sinks
streaming/  (the reference has no streaming; see its module docstring)
"""

from voltcast.constants import FEATURES_5MIN, Cadence, FIVE_MIN, HOURLY  # noqa: F401
