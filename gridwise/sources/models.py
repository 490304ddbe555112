"""Fitted models on disk: one folder per part, and a small text table that lists the parts and plain values."""

from __future__ import annotations

import json

from pyspark.ml import Model, PipelineModel
from pyspark.sql import SparkSession


def save_models(spark: SparkSession, folder: str, parts: dict[str, Model], values: dict) -> None:
    for name, part in parts.items():
        PipelineModel([part]).write().overwrite().save(f"{folder}/{name}")
    note = json.dumps({"parts": list(parts), "values": values})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/contents")


def load_models(spark: SparkSession, folder: str) -> tuple[dict[str, Model], dict]:
    """The saved parts by name; parts that were optional and not fitted are simply absent."""
    note = json.loads(spark.read.text(f"{folder}/contents").first()["value"])
    parts = {name: PipelineModel.load(f"{folder}/{name}").stages[0] for name in note["parts"]}
    return parts, note["values"]
