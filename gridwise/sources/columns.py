"""Column names: tidy them, check them, find the time and the target."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from gridwise.functions.scalars import nan_to_null
from gridwise.operators.validate import parse_ts_drop_bad
from gridwise.schemas import SITE

# Accepted names, in order of preference.
TIME_NAMES = ["datetime", "dt"]
TARGET_NAMES = ["Global_active_power", "global_active_power", "Active_Power", "power"]
TARGET_PATTERN = "active_power|power|consumption"

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def normalise_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def select_rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep the columns of `names` under their new names, in that order."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def time_column(df: DataFrame) -> str:
    for name in TIME_NAMES:
        if name in df.columns:
            return name
    raise ValueError("a 'datetime' or 'dt' column is needed")


def target_column(df: DataFrame) -> str:
    for name in TARGET_NAMES:
        if name in df.columns:
            return name
    numeric = [c for c, kind in df.dtypes if kind.startswith(NUMERIC) and c != SITE]
    if not numeric:
        raise ValueError("a target column such as Global_active_power is needed")
    return numeric[0]


def match_target_column(df: DataFrame) -> str:
    """First column whose name looks like power or consumption, else the first column."""
    for name in df.columns:
        if re.search(TARGET_PATTERN, name, re.IGNORECASE):
            return name
    return df.columns[0]


def resolve_columns(df: DataFrame) -> DataFrame:
    """Consumption rows of any shape to (site_id, ts, kw); rows without a readable time are dropped."""
    time, target = time_column(df), target_column(df)
    kept = select_rename(df, {SITE: SITE, time: "datetime", target: "kw"})
    if dict(df.dtypes)[time] == "string":
        parsed = parse_ts_drop_bad(kept)
    else:
        parsed = kept.withColumn("ts", F.col("datetime").cast("timestamp_ntz")).where("ts IS NOT NULL")
    kw = F.col("kw").try_cast("double") if dict(df.dtypes)[target] == "string" else F.col("kw")
    return parsed.select(SITE, "ts", nan_to_null(kw).alias("kw"))
