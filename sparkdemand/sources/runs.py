"""Saved training runs: pipelines, feature settings and one metadata row per run."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdemand.operators.features import FeatureConfig
from sparkdemand.operators.models import ForecastModel

RUN_SCHEMA = (
    "run_id string, dataset_name string, timestamp bigint, has_orders boolean, feature_count int, "
    "training_times map<string,double>, features string, models array<struct<name:string,path:string,inputs:array<string>,target:string>>"
)


def _safe(name: str) -> str:
    return re.sub("[ /.]", "_", name)[:40]


def save_run(
    spark: SparkSession,
    root: str,
    config: FeatureConfig,
    models: Mapping[str, ForecastModel],
    dataset_name: str = "session",
    times: Mapping[str, float] | None = None,
    now: int | None = None,
) -> str:
    """Write every model and append the run to ``root/runs``; returns the run id.

    The metadata row is written last, so a run that is listed is complete.
    """
    stamp = int(now if now is not None else time.time())
    run_id = f"{_safe(dataset_name)}_{stamp}"
    saved = []
    for name, model in models.items():
        path = f"{root}/models/{run_id}/{re.sub('[^A-Za-z0-9]+', '_', name)}"
        model.pipeline.write().overwrite().save(path)
        saved.append((name, path, list(model.feature_cols), model.target))
    row = (
        run_id,
        dataset_name,
        stamp,
        bool(config.order) and any(c.endswith(f"_{config.order}") for c in config.feature_columns),
        len(config.feature_columns),
        {k: float(v) for k, v in (times or {}).items()},
        config.to_json(),
        saved,
    )
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").json(f"{root}/runs")
    return run_id


def runs_table(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(f"{root}/runs")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Saved runs, newest first."""
    return (
        runs_table(spark, root)
        .orderBy(F.desc("timestamp"), F.desc("run_id"))
        .select(
            F.col("run_id").alias("Run_ID"),
            F.col("dataset_name").alias("Dataset"),
            F.col("feature_count").alias("Features"),
            F.col("has_orders").alias("Has_Orders"),
            F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm").alias("Saved_At"),
        )
    )


def load_latest(spark: SparkSession, root: str, dataset_name: str | None = None) -> dict | None:
    """Newest run by time, of one dataset if named: feature settings, models and metadata; ``None`` if there is none."""
    runs = runs_table(spark, root)
    if dataset_name:
        runs = runs.where(F.col("dataset_name") == dataset_name)
    row = runs.orderBy(F.desc("timestamp"), F.desc("run_id")).limit(1).first()
    if row is None:
        return None
    models = {
        m["name"]: ForecastModel(m["name"], tuple(m["inputs"]), PipelineModel.load(m["path"]), m["target"]) for m in row["models"]
    }
    return {
        "run_id": row["run_id"],
        "config": FeatureConfig.from_json(row["features"]),
        "models": models,
        "metadata": json.loads(json.dumps({k: row[k] for k in ("run_id", "dataset_name", "timestamp", "has_orders", "feature_count", "training_times")})),
    }
