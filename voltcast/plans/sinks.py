"""Sinks: result tables to CSV / JSON / Parquet, models to storage.

Small result tables (one row per model, feature, trial or epoch; bounded by the
number of those) are written as one file with ``coalesce(1)``; data-sized
tables (predictions, features) keep their partitioning and write many files.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltcast import constants as C


def write_table(df: DataFrame, path: str, fmt: str = "csv", small: bool = False,
                partition_by: list[str] | None = None) -> None:
    out = df.coalesce(1) if small else df
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def metrics_for_export(board: DataFrame) -> DataFrame:
    """Rounded board in display names, ordered by RMSE (the stored metrics layout)."""
    return board.orderBy("rank").select(F.col("model").alias("Model"), "MAE", "RMSE", F.col("R2").alias("R²"),
                                        F.col("MAPE").alias("MAPE (%)"))


def write_metrics(board: DataFrame, path: str) -> None:
    write_table(metrics_for_export(board), path, "csv", small=True)


def write_predictions(wide: DataFrame, path: str, fmt: str = "csv") -> None:
    write_table(wide, path, fmt)


def write_importances(wide: DataFrame, path: str) -> None:
    write_table(wide, path, "csv", small=True)


def write_trials(history: DataFrame, path: str) -> None:
    """(Trial, MAE, Running_Min)."""
    write_table(history.select(F.col("trial").alias("Trial"), F.col("mae").alias("MAE"),
                               F.col("running_min").alias("Running_Min")).orderBy("Trial"),
                path, "csv", small=True)


def write_fit_history(history: DataFrame, path: str) -> None:
    """(Epoch, Loss, Val_Loss)."""
    write_table(history.select(F.col("iteration").alias("Epoch"), F.col("loss").alias("Loss"),
                               F.col("val_loss").alias("Val_Loss")).orderBy("Epoch"), path, "csv", small=True)


def write_config(config: DataFrame, path: str) -> None:
    """One-row configuration document (blend weights, best model)."""
    write_table(config, path, "json", small=True)


def report_json(board: DataFrame, importances: DataFrame) -> DataFrame:
    """One JSON document combining the metrics and the feature importances.

    Both inputs have one row per model / feature, so collecting them into one
    row is bounded by those counts, not by the data.
    """
    m = board.agg(F.sort_array(F.collect_list(F.struct("rank", "model", "MAE", "RMSE", "R2", "MAPE")))
                  .alias("metrics"))
    first = importances.columns[0]  # the feature name; features stand in the model's order, others after them by name
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in C.FEATURES_5MIN]), F.col(f"`{first}`")), F.lit(0))
    place = F.when(place > 0, place).otherwise(F.lit(len(C.FEATURES_5MIN) + 1))
    own = F.struct(*[F.col(f"`{c}`") for c in importances.columns])
    f = importances.agg(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("at"), F.col(f"`{first}`").alias("name"), own.alias("row")))),
                                    lambda x: x["row"])).scalar()
    return m.select(F.to_json(F.struct("metrics", f.alias("features"))).alias("report"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, df: DataFrame, name: str, label: str = C.TARGET) -> DataFrame:
    """Batch scoring with a loaded model, as long predictions."""
    scored = model.transform(df)
    return scored.select("datetime", F.lit(name).alias("model"), F.col(label).alias("actual"),
                         F.col("prediction").alias("predicted"))
