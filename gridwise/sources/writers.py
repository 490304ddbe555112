"""Forecast tables on disk, by run. A run is all tables of a date; readers see it whole or not at all.

Each attempt at a run writes its tables into folders of its own. The note of the run, which names the attempt, is written
last and replaces the one of an earlier attempt at that date; readers take only files of attempts that are named. So an
attempt that broke off is never seen, and a repeated run replaces the first one at once.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridwise.session import delete_folder, list_folder

RUNS = "runs"
KEYS = ["run_date", "attempt"]
NOTE = T.StructType([T.StructField("run_date", T.DateType()), T.StructField("name", T.StringType()), T.StructField("attempt", T.StringType())])


def write_forecasts(tables: dict[str, DataFrame], folder: str, run_date: dt.date, file_format: str = "parquet") -> str:
    """Write each table to `folder/name` and then the note of the run; gives the name of the attempt."""
    if not tables or RUNS in tables:
        raise ValueError(f"a run needs tables, none of them named {RUNS}")
    # A letter first, so that no reader takes the name for a number.
    attempt = f"a{uuid.uuid4().hex}"
    for name, table in tables.items():
        marked = table.withColumns({"run_date": F.lit(run_date), "attempt": F.lit(attempt)})
        marked.write.mode("append").partitionBy(*KEYS).format(file_format).save(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    note = spark.createDataFrame([(run_date, name, attempt) for name in tables], NOTE).coalesce(1)
    note.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(f"{folder}/{RUNS}")
    return attempt


def complete_runs(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """The attempts that count: run_date, name, attempt."""
    runs = spark.read.schema(NOTE).parquet(f"{folder}/{RUNS}")
    return runs if name is None else runs.where(F.col("name") == name)


def read_forecasts(
    spark: SparkSession, folder: str, name: str, run_date: dt.date | None = None, file_format: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """The table of one run or of all runs. Text formats need the table's schema."""
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, NOTE["run_date"], NOTE["attempt"]]))
    table = reader.format(file_format).load(f"{folder}/{name}")
    runs = complete_runs(spark, folder, name)
    if run_date is not None:
        table, runs = table.where(F.col("run_date") == F.lit(run_date)), runs.where(F.col("run_date") == F.lit(run_date))
    # One row for each run; folders of other attempts aren't read.
    return table.join(F.broadcast(runs.select(*KEYS)), KEYS, "left_semi").drop(*KEYS)


def drop_other_attempts(spark: SparkSession, folder: str, run_date: dt.date) -> int:
    """Delete the files of a date's attempts that no longer count; gives how many folders went."""
    kept = {(r["name"], r["attempt"]) for r in complete_runs(spark, folder).where(F.col("run_date") == F.lit(run_date)).collect()}
    gone = 0
    for name in list_folder(spark, folder):
        for part in list_folder(spark, f"{folder}/{name}/run_date={run_date}") if name != RUNS else ():
            if part.startswith("attempt=") and (name, part.removeprefix("attempt=")) not in kept:
                gone += delete_folder(spark, f"{folder}/{name}/run_date={run_date}/{part}")
    return gone
