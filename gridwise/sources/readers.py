"""CSV and JSON readers. A file without a `site_id` column belongs to the site given by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridwise.functions.scalars import nan_to_null
from gridwise.operators.series import last_n_rows
from gridwise.operators.tariff import tariff_bounds
from gridwise.operators.validate import parse_ts_drop_bad
from gridwise.schemas import PANELS, RAW_READINGS, SENSORS, SITE, TARIFF_COLUMNS
from gridwise.sources.columns import normalise_header, require_columns, resolve_columns, time_column


def _with_site(df: DataFrame, site_id: int | None) -> DataFrame:
    if SITE in df.columns:
        return df.withColumn(SITE, F.col(SITE).cast("long"))
    if site_id is None:
        raise ValueError("no site_id column: give the site_id of this file")
    return df.withColumn(SITE, F.lit(site_id).cast("long"))


def _text_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text: no pass over the data to guess types."""
    return spark.read.csv(path, header=True)


def solar_rows(raw: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Text or typed rows with a `datetime` to readings; unreadable times are dropped, unreadable numbers are null."""
    sensors = [nan_to_null(F.col(c).try_cast("double")).alias(c) for c in SENSORS]
    return parse_ts_drop_bad(raw).select(SITE, "ts", *sensors, *keep)


def read_solar_csv(spark: SparkSession, path: str | list[str], site_id: int | None = None) -> DataFrame:
    raw = require_columns(_text_csv(spark, path), ["datetime", *SENSORS])
    return solar_rows(_with_site(raw, site_id))


def read_consumption_csv(
    spark: SparkSession, path: str | list[str], site_id: int | None = None, last: int | None = None
) -> DataFrame:
    """All rows as (site_id, ts, kw), or the `last` ones of each site; headers in any case, spaces allowed."""
    raw = normalise_header(_text_csv(spark, path))
    require_columns(raw, [time_column(raw), "global_active_power"])
    rows = resolve_columns(_with_site(raw, site_id))
    return rows if last is None else last_n_rows(rows, last)


def read_tariff_csv(spark: SparkSession, path: str | list[str], site_id: int | None = None) -> DataFrame:
    """The last row of the file per site, in file order, clipped and cast."""
    # Position of a row: file, then block in the file, then row in the block.
    raw = _text_csv(spark, path).select("*", "_metadata.file_path", "_metadata.file_block_start")
    raw = normalise_header(raw).withColumn("row_id", F.monotonically_increasing_id())
    raw = _with_site(require_columns(raw, TARIFF_COLUMNS), site_id)
    last = F.max_by(F.struct(*TARIFF_COLUMNS), F.struct("file_path", "file_block_start", "row_id")).alias("last")
    return tariff_bounds(raw.groupBy(SITE).agg(last).select(SITE, "last.*"))


# The fields of a solar request.
SOLAR_REQUEST = T.StructType([
    T.StructField(SITE, T.LongType()),
    T.StructField("historical_data", T.ArrayType(T.StructType(RAW_READINGS.fields[1:]))),
    T.StructField("panel_area_m2", T.DoubleType()),
    T.StructField("panel_efficiency", T.DoubleType()),
])


def solar_requests(requests: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Readings and panels from requests whose place in time is given by the columns `order`.

    Each request carries its own history, so histories overlap: a site has one row for each time and one panel, those of
    its newest request that has them. A panel area that isn't positive or an efficiency outside of (0, 1] counts as missing.
    """
    place = F.struct(*order)
    rows = requests.select(SITE, place.alias("place"), F.posexplode("historical_data").alias("row_no", "row"))
    parsed = solar_rows(rows.select(SITE, "row.*", F.struct("place", "row_no").alias("place")), keep=["place"])
    newest = parsed.groupBy(SITE, "ts").agg(F.max_by(F.struct(*SENSORS), "place").alias("row"))
    area, efficiency = F.col("panel_area_m2"), F.col("panel_efficiency")
    panels = requests.select(
        SITE, place.alias("place"), F.when(area > 0, area).alias("area_m2"),
        F.when((efficiency > 0) & (efficiency <= 1), efficiency).alias("efficiency"),
    )
    latest = panels.groupBy(SITE).agg(F.max_by(F.struct("area_m2", "efficiency"), "place").alias("panel"))
    return newest.select(SITE, "ts", "row.*"), latest.select(SITE, "panel.*").select(*PANELS.names)


def read_solar_json(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests, one per line, to readings and panels; later files and lines are newer."""
    requests = spark.read.schema(SOLAR_REQUEST).json(path).select("*", "_metadata.file_path", "_metadata.file_block_start")
    return solar_requests(requests.withColumn("line", F.monotonically_increasing_id()), ["file_path", "file_block_start", "line"])


def read_consumption_json(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Requests with rows of any shape, or plain rows; without a schema Spark reads the files once to infer it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    raw = reader.json(path)
    if "historical_data" in raw.columns:
        raw = raw.select(SITE, F.explode("historical_data").alias("row")).select(SITE, "row.*")
    return resolve_columns(raw)
