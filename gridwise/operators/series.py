"""Ordered series per site: windows that stay bounded when one site holds much of the data, last-N, row order.

Row-based windows (`lag`, rolling frames) need a site's rows in one sorted partition. That is fine for normal sites, but
a site with a large share of all rows would be one giant task. `over_series` therefore measures the longest site first.
Long sites are cut into blocks of equal row count, each carrying the few rows before and after it that the frames can
reach, so that every window partition has a fixed size and the result is the same. What depends on all rows before, however
far back, is a scan (`scan.py`): it carries one row per block to the next block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from gridwise.operators.scan import Scan
from gridwise.schemas import SITE
from gridwise.session import use_checkpoint_dir

# A site with more rows than this is cut into blocks of this many rows.
ROWS_PER_BLOCK = 1_000_000
# At most this many sites are treated as long: a long site holds more than 1/MAX_LONG_SITES of all rows.
MAX_LONG_SITES = 65_536
# Rows that a task gets where they grow wide or go through many sorts. Shuffled rows tell by their size in bytes how many tasks
# there are, which for narrow ones are too few.
ROWS_PER_TASK = 100_000


def order_columns(df: DataFrame) -> list[str]:
    """Time first, then every other sortable column, so that rows with equal times have one order."""
    skip = ("array", "map", "struct", "variant")
    return ["ts"] + [c for c, kind in df.dtypes if c not in (SITE, "ts") and not kind.startswith(skip)]


def site_window(df: DataFrame) -> WindowSpec:
    """Rows of a site in time order, for series known to be short."""
    return Window.partitionBy(SITE).orderBy(*order_columns(df))


def long_sites(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame | None:
    """Sites too long for one task with their row counts, fewer than MAX_LONG_SITES of them; None without any.

    Runs one count per site (combined before the shuffle) and brings a single row to the driver.
    """
    return _measured(df, rows_per_block)[0]


def _measured(df: DataFrame, rows_per_block: int, most: int | None = None) -> tuple[DataFrame | None, int, int]:
    """`long_sites`, the rows of the longest site, and those of all sites, of which at most `most` of each count."""
    counts = df.groupBy(SITE).agg(F.count("*").alias("site_rows"))
    kept = F.col("site_rows") if most is None else F.least("site_rows", F.lit(most))
    total, longest, number = F.sum("site_rows"), F.max("site_rows"), F.sum(kept)
    seen = counts.agg(total.alias("total"), longest.alias("longest"), number.alias("kept")).first()
    limit = max(rows_per_block, (seen["total"] or 0) // MAX_LONG_SITES)
    longest = seen["longest"] or 0
    return (counts.where(F.col("site_rows") > limit) if longest > limit else None), longest, seen["kept"] or 0


def _tasks(df: DataFrame, rows: int) -> int | None:
    """The number of tasks for so many rows; None where Spark may choose it."""
    tasks = -(-rows // ROWS_PER_TASK)
    return max(tasks, df.sparkSession.sparkContext.defaultParallelism) if tasks > 1 else None


def _dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return df.repartition(*([tasks] if tasks else []), *keys)


def over_series(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
    bounded: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
    scan: Scan | None = None,
    deal: bool = False,
) -> DataFrame:
    """`build(df, window)` adds columns whose frames reach at most `before` rows back and `after` rows ahead.

    A `scan` goes first; its columns depend on all rows before and are there for `build`. `bounded` says that sites are
    known to be short, for example after `last_n_rows`, and skips measuring them. `deal` bounds the rows of a task, for
    frames that make rows much wider.
    """
    order = order_columns(df)
    long, longest, rows = (None, 0, 0) if bounded else _measured(df, rows_per_block)
    tasks = _tasks(df, rows) if deal else None
    whole = Window.partitionBy(SITE).orderBy(*order)
    if long is None:
        df = _dealt(df, tasks, SITE) if tasks else df
        return build(scan.whole(df, whole) if scan else df, whole)

    # Fewer than MAX_LONG_SITES rows, so the broadcast is bounded whatever the data size.
    long = F.broadcast(long)
    short_part = df.join(long, SITE, "left_anti")
    short_part = (scan.whole(short_part, whole) if scan else short_part).withColumns(
        {"block": F.lit(0).cast("long"), "core": F.lit(True)}
    )
    numbered = _numbered(df.join(long.select(SITE), SITE, "left_semi"), order)
    if scan:
        home = numbered.withColumn("block", F.floor(F.col("pos") / rows_per_block).cast("long"))
        scanned = scan.blocks(_dealt(home, tasks, SITE, "block"), -(-longest // rows_per_block))
        numbered = scanned.drop("block")
    blocks = _cut_into_blocks(numbered, before, after, rows_per_block)
    # Hash on both columns: partitioning by site alone would bring the blocks of a long site together again.
    together = _dealt(short_part.unionByName(blocks), tasks, SITE, "block")
    out = build(together, Window.partitionBy(SITE, "block").orderBy(*order))
    return out.where("core").drop("block", "core")


def scanned(df: DataFrame, scan: Scan, bounded: bool = False, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The columns of a scan alone."""
    return over_series(df, lambda d, w: d, bounded=bounded, rows_per_block=rows_per_block, scan=scan)


def _cut_into_blocks(ranked: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """Send each numbered row to its block and to the blocks whose frames reach it."""
    if max(before, after) > size:
        raise ValueError("a block must be at least as long as the frames")
    home = F.floor(F.col("pos") / size).cast("long")
    offset = F.col("pos") - home * size
    last = F.floor((F.col("site_rows") - 1) / size).cast("long")
    reached = F.array(
        home,
        F.when((offset >= size - before) & (home < last), home + 1),
        F.when((offset < after) & (home > 0), home - 1),
    )
    return (
        ranked.withColumn("home", home)
        .withColumn("block", F.explode(F.array_compact(reached)))
        .withColumn("core", F.col("block") == F.col("home"))
        .drop("pos", "home", "site_rows")
    )


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add `pos`, the 0-based row number in the site, and `site_rows`, without one task per site.

    A range sort on (site, time, ...) splits long sites by row count. The row number in the sorted partition plus the
    rows of the same site in earlier partitions is the row number in the site. The range bounds come from a sample, so
    the sorted rows are checkpointed and both uses below read the same partitions.
    """
    use_checkpoint_dir(rows.sparkSession)
    local = F.monotonically_increasing_id()
    ranged = (
        rows.repartitionByRange(SITE, *order)
        .sortWithinPartitions(SITE, *order)
        .withColumn("local_id", local)
        .checkpoint()
        .withColumn("part", F.shiftright("local_id", 33))
    )
    # One row per site and partition: at most long sites + partitions, since each partition is one range.
    pieces = ranged.groupBy(SITE, "part").agg(F.count("*").alias("n"), F.min("local_id").alias("first_id"))
    w = Window.partitionBy(SITE)
    pieces = pieces.select(
        SITE,
        "part",
        "first_id",
        (F.sum("n").over(w.orderBy("part")) - F.col("n")).alias("earlier"),
        F.sum("n").over(w).alias("site_rows"),
    )
    return (
        ranged.join(F.broadcast(pieces), [SITE, "part"])
        .withColumn("pos", F.col("earlier") + F.col("local_id") - F.col("first_id"))
        .drop("part", "local_id", "first_id", "earlier")
    )


def last_n_rows(
    df: DataFrame, n: int, bounded: bool = False, rows_per_block: int = ROWS_PER_BLOCK, deal: bool = False
) -> DataFrame:
    """The latest `n` rows of each site. `deal` bounds the rows of a task, for what is built on them.

    Spark limits each site to `n` rows per task before the shuffle. A site spread over very many tasks would still send
    `n` rows from each to one place, so when a long site exists the limit runs once more in between, per site and salt.
    Any split of the rows gives the same answer, so the salt can be the task number.
    """
    order = [F.col(c).desc() for c in order_columns(df)]
    out = df
    long, _, rows = (None, 0, 0) if bounded else _measured(df, rows_per_block, n)
    if long is not None:
        out = _limit(out.withColumn("salt", F.spark_partition_id() % 512), [SITE, "salt"], order, n).drop("salt")
    out = _limit(out, [SITE], order, n)
    tasks = _tasks(df, rows) if deal else None
    return _dealt(out, tasks, SITE) if tasks else out


def _limit(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("row_rank", rank).where(F.col("row_rank") <= n).drop("row_rank")


def preview_tail(df: DataFrame) -> DataFrame:
    return last_n_rows(df, 10)


def last_row(df: DataFrame) -> DataFrame:
    """The latest row of each site, as an aggregate: combined before the shuffle, safe for any site size."""
    rest = [c for c in order_columns(df) if c != "ts"]
    nested = [c for c in df.columns if c not in (SITE, "ts", *rest)]
    latest = F.max_by(F.struct("ts", *rest, *nested), F.struct("ts", *rest)).alias("latest")
    return df.groupBy(SITE).agg(latest).select(SITE, "latest.*").select(*df.columns)


def head_k(forecast: DataFrame, k: int) -> DataFrame:
    return forecast.where(F.col("step") <= k)


def append_rows(history: DataFrame, current: DataFrame) -> DataFrame:
    """The current reading of each site after its history."""
    return history.unionByName(current)


def sort_by_time(df: DataFrame) -> DataFrame:
    """Site by site in time order. Range-partitioned, so no task holds more than its share."""
    return df.orderBy(SITE, *order_columns(df))


def micros(ts: Column | str) -> Column:
    """Whole microseconds since the epoch of a wall-clock timestamp (the session runs in UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def gap_seconds(w: WindowSpec) -> Column:
    """Seconds since the previous row; null on the first."""
    return (micros("ts") - micros(F.lag("ts").over(w))) / 1_000_000


def span_hours(first: Column, last: Column) -> Column:
    return (micros(last) - micros(first)) / 3_600_000_000


def gap_diff(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    return over_series(df, lambda d, w: d.withColumn("gap_s", gap_seconds(w)), before=1, rows_per_block=rows_per_block)
