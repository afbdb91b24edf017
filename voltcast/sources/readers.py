"""Readers: raw load CSV with header repairs, stored result tables, JSON documents.

The raw CSV layout: an unnamed index column, ``datetime``, ``Power demand``
(the target), weather columns, the calendar columns and ``moving_avg_3``.
Headers may carry spaces. All values are read as text and cast to declared
types (no schema inference pass over the data).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField, StructType)

from voltcast.constants import DEFAULT_WEIGHTS

RAW_TYPES = {
    "datetime": "timestamp_ntz", "load": "double", "temp": "double", "dwpt": "double", "rhum": "double",
    "wdir": "double", "wspd": "double", "pres": "double", "year": "int", "month": "int", "day": "int",
    "hour": "int", "minute": "int",
}
INDEX_HEADERS = ("Unnamed: 0", "_c0", "")
DERIVED_DROPS = ("moving_avg_3",)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the path (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).exists(p))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """First existing path of an ordered candidate list; error when none exists."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(f"none of the candidate paths exists: {list(paths)}")


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def drop_columns(df: DataFrame, cols: Sequence[str], strict: bool = False) -> DataFrame:
    """Drop columns; ``strict`` raises when one is absent (the training script's behaviour)."""
    missing = [c for c in cols if c not in df.columns]
    if strict and missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*[c for c in cols if c in df.columns])


# FIXED values: the words that CSV readers of data-frame libraries take as missing by default.
MISSING_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
                 "NaN", "None", "n/a", "nan", "null"]


def present(col: str) -> Column:
    """Trimmed text of a CSV field, null for a missing-value word."""
    v = F.trim(F.col(f"`{col}`"))
    return F.when(~v.isin(MISSING_WORDS), v)


def read_load_csv(spark: SparkSession, path: str | Sequence[str], strict: bool = True,
                  target: str = "Power demand") -> DataFrame:
    """Raw load CSV -> typed frame (datetime, load, weather, calendar columns).

    Steps: header CSV read as text; trim headers; drop the index and the
    pre-computed moving average; rename the target to ``load``; parse
    ``datetime``; missing-value words become null; cast to declared types.
    """
    if not isinstance(path, str):
        path = first_existing(spark, path)
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = trim_headers(df)
    index_cols = [c for c in df.columns if c in INDEX_HEADERS]
    if strict and not index_cols:
        raise KeyError("index column not found")
    df = drop_columns(df, index_cols)
    df = drop_columns(df, DERIVED_DROPS, strict=strict)
    df = df.withColumnRenamed(target, "load")
    out = []
    for c in df.columns:
        t = RAW_TYPES.get(c)
        if t == "timestamp_ntz":
            out.append(F.to_timestamp_ntz(present(c)).alias(c))
        elif t:
            out.append(present(c).cast(t).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def write_raw_csv(df: DataFrame, path: str) -> None:
    """Write a typed load frame back in the raw layout (padded headers, index, extra column)."""
    cols = [F.monotonically_increasing_id().cast("string").alias(""),
            F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias(" datetime "),
            F.col("load").alias("Power demand "),
            *[F.col(c).alias(c) for c in ("temp", "dwpt", "rhum", "wdir", "wspd", "pres")],
            *[F.col(c).alias(c) for c in ("year", "month", "day", "hour", "minute")],
            F.lit(None).cast("double").alias("moving_avg_3")]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


# --------------------------------------------------------------------------- stored result tables

METRICS_SCHEMA = StructType([StructField("Model", StringType()), StructField("MAE", DoubleType()),
                             StructField("RMSE", DoubleType()), StructField("R²", DoubleType()),
                             StructField("MAPE (%)", DoubleType())])
TRIALS_SCHEMA = StructType([StructField("Trial", IntegerType()), StructField("MAE", DoubleType()),
                            StructField("Running_Min", DoubleType())])
EPOCHS_SCHEMA = StructType([StructField("Epoch", IntegerType()), StructField("Loss", DoubleType()),
                            StructField("Val_Loss", DoubleType())])
IMPORTANCE_SCHEMA = StructType([StructField("Feature", StringType()), StructField("Random Forest", DoubleType()),
                                StructField("XGBoost", DoubleType()), StructField("LightGBM", DoubleType())])


def read_table_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics table -> internal names (model, MAE, RMSE, R2, MAPE)."""
    df = read_table_csv(spark, path, METRICS_SCHEMA)
    return df.select(F.col("Model").alias("model"), "MAE", "RMSE", F.col("`R²`").alias("R2"),
                     F.col("`MAPE (%)`").alias("MAPE"))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return read_table_csv(spark, path, TRIALS_SCHEMA)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return read_table_csv(spark, path, EPOCHS_SCHEMA)


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    return read_table_csv(spark, path, IMPORTANCE_SCHEMA)


def read_predictions(spark: SparkSession, path: str, limit: int = 2016) -> DataFrame:
    """Wide predictions; the latest ``limit`` rows by datetime, oldest first (``limit <= 0``: all rows).

    Rows of equal times rank by their values, column by column, so the cut does
    not depend on how the files were read.
    """
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    cols = [F.to_timestamp_ntz("datetime").alias("datetime")] + [
        F.col(f"`{c}`").cast("double").alias(c) for c in df.columns if c != "datetime"]
    df = df.select(*cols)
    if limit > 0:
        df = df.orderBy(F.col("datetime").desc(), *[F.col(f"`{c}`") for c in df.columns if c != "datetime"]).limit(limit)
    return df.orderBy("datetime", *[F.col(f"`{c}`") for c in df.columns if c != "datetime"])


def read_config(spark: SparkSession, path: str, defaults: dict | None = None) -> DataFrame:
    """One-row JSON document; defaults fill absent fields, or the whole row when the file is absent."""
    defaults = dict(DEFAULT_WEIGHTS if defaults is None else defaults)
    if path_exists(spark, path):
        df = spark.read.option("multiLine", True).json(path)
        for k, v in defaults.items():
            if k in df.columns:
                df = df.withColumn(k, F.coalesce(F.col(k), F.lit(v)))
            else:
                df = df.withColumn(k, F.lit(v))
        return df
    fields = [StructField(k, DoubleType() if isinstance(v, float) else
                          (LongType() if isinstance(v, int) else StringType())) for k, v in defaults.items()]
    return spark.createDataFrame([tuple(defaults.values())], StructType(fields))


def profile_document(spark: SparkSession, path: str, compute=None, columns: Sequence[str] = ()) -> DataFrame:
    """Feature-means document: read it when present, else compute, write and return it.

    ``compute()`` returns the one-row profile DataFrame (e.g. the feature means of
    the complete rows); it is only evaluated when the document is absent. Without
    ``compute`` an absent document means zero for each of ``columns``, and nothing
    is written.
    """
    if path_exists(spark, path):
        return spark.read.option("multiLine", True).json(path)
    if compute is None:
        return spark.range(1).select(*[F.lit(0.0).alias(c) for c in columns])
    prof = compute()
    prof.coalesce(1).write.mode("overwrite").json(path)
    return spark.read.json(path)
