"""Hourly series: means per hour, a full hour spine, filling, the resampling rule, the hourly profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from gridwise.functions.scalars import null_to_zero
from gridwise.operators.scan import LastKnown
from gridwise.operators.series import (
    ROWS_PER_BLOCK, gap_diff, gap_seconds, last_n_rows, micros, scanned, site_window, span_hours,
)
from gridwise.schemas import SITE
from gridwise.session import use_checkpoint_dir

# The resampling rule and the profile defaults.
DENSE_ROWS = 24
DENSE_FACTOR = 1.5
SHORT_GAP_S = 45 * 60
HALF_HOUR_S = 30 * 60
HOUR_MICROS = 3_600_000_000
# Hours that one array holds at most.
HOURS_PER_BLOCK = 4096
PROFILE_DEFAULT = 0.1
PROFILE_FLOOR = 0.01


def hour_of(ts: Column | str) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def series_span(df: DataFrame) -> DataFrame:
    """Row count, first and last time and the hours between them, per site."""
    return df.groupBy(SITE).agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        span_hours(F.min("ts"), F.max("ts")).alias("span_hours"),
    )


def median_gap(df: DataFrame) -> DataFrame:
    """Exact median of the gaps between consecutive rows, per site.

    Equal gaps are counted first. Gaps of a site add up to its span, so it has at most sqrt(2 * span in microseconds)
    distinct ones, however many rows it has; running counts over these tell which gaps stand in the middle.
    """
    gaps = gap_diff(df).where("gap_s IS NOT NULL").groupBy(SITE, "gap_s").agg(F.count("*").alias("times"))
    w = Window.partitionBy(SITE)
    placed = gaps.withColumns({
        "upto": F.sum("times").over(w.orderBy("gap_s").rowsBetween(Window.unboundedPreceding, 0)), "gaps": F.sum("times").over(w),
    })
    middle = [F.min(F.when(F.col("upto") * 2 >= F.col("gaps") + more, F.col("gap_s"))) for more in (0, 1)]
    # With an even number of gaps the median lies between two of them: the last of the lower half, the first of the upper.
    return placed.groupBy(SITE).agg(
        F.when(F.max("gaps") % 2 == 1, middle[1]).otherwise((middle[0] + middle[1]) / 2).alias("median_gap_s")
    )


def too_dense(n: Column, hours: Column) -> Column:
    """Rule A: more rows than 1.5 per hour."""
    return (n > DENSE_ROWS) & (hours > 0) & (n > hours * DENSE_FACTOR)


def hour_marks(df: DataFrame) -> DataFrame:
    """Per site and hour: rows, the first and last time, and the times next to the middle of the hour.

    All of these are combined in each task, so a shuffle carries one row per site, hour and task.
    """
    late = F.minute("ts") >= 30
    return df.groupBy(SITE, hour_of("ts").alias("hour")).agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.max(F.when(~late, F.col("ts"))).alias("early"), F.min(F.when(late, F.col("ts"))).alias("late"),
    )


def gap_counts(df: DataFrame) -> DataFrame:
    """Per site: rows, span, gaps, how many are short (below 45 minutes), the shortest of the others, and what is known of
    the longest short one. No site's gaps are brought together.

    A gap of 45 minutes or more reaches over the middle or the end of an hour, so the marks of the hours show all of these.
    The `unseen` gaps, from one row to the next within half an hour, are short, and their lengths stay unknown.
    """
    w = Window.partitionBy(SITE).orderBy("hour")
    across = seconds(F.col("first"), F.lag("last").over(w))
    inside = seconds(F.col("late"), F.col("early"))
    marked = hour_marks(df).withColumns({"across": across, "inside": inside})
    seen = ("across", "inside")
    long = [F.when(F.col(c) >= SHORT_GAP_S, F.col(c)) for c in seen]
    short = [F.when(F.col(c) < SHORT_GAP_S, F.col(c)) for c in seen]
    counted = marked.groupBy(SITE).agg(
        F.sum("n").alias("n"), F.min("first").alias("first_ts"), F.max("last").alias("last_ts"),
        (F.sum("n") - F.sum(F.col("across").isNotNull().cast("int") + F.col("inside").isNotNull().cast("int")) - 1).alias("unseen"),
        F.sum(sum(x.isNotNull().cast("int") for x in long)).alias("long_gaps"),
        F.min(F.least(*long)).alias("shortest_long_s"), F.max(F.greatest(*short)).alias("longest_short_s"),
        # Hours of which not every row is the first or the last one.
        F.max("n").alias("most_in_hour"),
    )
    return counted.withColumns({
        "short_gaps": F.col("n") - 1 - F.col("long_gaps"), "span_hours": span_hours(F.col("first_ts"), F.col("last_ts")),
    })


def seconds(later: Column, sooner: Column) -> Column:
    return (micros(later) - micros(sooner)) / 1_000_000


def median_is_short(longest_short: Column) -> Column:
    """Rule B from counts: is the median gap below 45 minutes? Only halves of equal size need the gaps next to the middle."""
    short, long = F.col("short_gaps"), F.col("long_gaps")
    between = (F.coalesce(longest_short, F.lit(0.0)) + F.col("shortest_long_s")) / 2 < SHORT_GAP_S
    return F.when(short == long, (short > 0) & between).otherwise(short > long)


def undecided() -> Column:
    """Whether rule B hangs on a gap that the hours don't show: halves of equal size, and unseen gaps that may matter."""
    limit = 2 * SHORT_GAP_S - F.col("shortest_long_s")
    unknown = (F.col("short_gaps") == F.col("long_gaps")) & (F.col("unseen") > 0) & (limit > 0) & (limit < HALF_HOUR_S)
    return F.coalesce(unknown & (F.coalesce("longest_short_s", F.lit(0.0)) < limit), F.lit(False))


def needs_resample(df: DataFrame) -> DataFrame:
    """Per site: should the series be resampled to hours? Rule A (dense) or rule B (median gap below 45 minutes).

    One pass over the times, in which only marks of hours are shuffled; what it gives, one row per site, is checkpointed,
    so that plans which route rows by it don't repeat it. Rows are read again only for sites whose rule hangs on a gap within
    half an hour. Rule B looks at the series after rule A has acted.
    """
    use_checkpoint_dir(df.sparkSession)
    times = df.select(SITE, "ts")
    sites = gap_counts(times).withColumns({"rule_a": too_dense(F.col("n"), F.col("span_hours")), "open": undecided()})
    sites = sites.withColumn("open", F.col("open") & ~F.col("rule_a")).checkpoint()
    longest = F.col("longest_short_s")
    if not sites.where("open").isEmpty():
        # Sites that rule A leaves alone have few rows for their span, so their rows fit one window.
        rows = times.join(sites.where("open").select(SITE), SITE, "left_semi").repartition(SITE)
        gap = gap_seconds(Window.partitionBy(SITE).orderBy("ts"))
        exact = rows.withColumn("gap_s", gap).where(F.col("gap_s") < SHORT_GAP_S).groupBy(SITE).agg(F.max("gap_s").alias("exact_s"))
        sites = sites.join(exact, SITE, "left")
        longest = F.coalesce("exact_s", "longest_short_s")
    rule_b = ~F.col("rule_a") & (F.col("n") > 1) & median_is_short(longest)
    return sites.withColumn("rule_b", F.coalesce(rule_b, F.lit(False))).withColumn("resample", F.col("rule_a") | F.col("rule_b")).select(
        SITE, "n", "span_hours", "short_gaps", "long_gaps", "most_in_hour", "rule_a", "rule_b", "resample"
    )


def hourly_means(df: DataFrame) -> DataFrame:
    """Mean per site and hour. Partial sums per task, so a site with many rows shuffles one row per hour and task."""
    return df.groupBy(SITE, hour_of("ts").alias("ts")).agg(F.avg("kw").alias("kw"))


def every_hour(rows: DataFrame) -> DataFrame:
    """Repeat each row (ts, until) for the hours from `ts` to `until`, with `from` the time that it had.

    Gaps become blocks first and blocks hours after it, one after the other, so that a wrong clock doesn't make one row hold
    an array of millions of hours.
    """
    size = F.lit(HOURS_PER_BLOCK * HOUR_MICROS)
    number = lambda c: ((micros(c) - F.pmod(micros(c), size)) / size).cast("long")
    start = F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + block * INTERVAL '{HOURS_PER_BLOCK}' HOUR")
    blocks = rows.withColumnRenamed("ts", "from").withColumn("block", F.explode(F.sequence(number("from"), number("until"))))
    end = start + F.expr(f"INTERVAL '{HOURS_PER_BLOCK}' HOUR") - F.expr("INTERVAL '0.000001' SECOND")
    inside = F.sequence(F.greatest(F.col("from"), start), F.least(F.col("until"), end), F.expr("INTERVAL 1 HOUR"))
    return blocks.withColumn("ts", F.explode(inside)).drop("until", "block")


def until_next(w: WindowSpec) -> Column:
    """The last hour before the next row; of the last row its own."""
    return F.coalesce(F.lead("ts").over(w) - F.expr("INTERVAL 1 HOUR"), F.col("ts"))


def hour_spine(hourly: DataFrame) -> DataFrame:
    """Every hour from the first to the last; the hours in between come out without a value."""
    w = Window.partitionBy(SITE).orderBy("ts")
    spread = every_hour(hourly.withColumn("until", until_next(w)))
    return spread.select(SITE, "ts", F.when(F.col("ts") == F.col("from"), F.col("kw")).alias("kw"))


def ffill_bfill(series: DataFrame, column: str = "kw", bounded: bool = False, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Fill forward, then fill what is left at the start of a site with its first value. Long sites are cut."""
    return scanned(series, LastKnown(column), bounded, rows_per_block)


def resample_hourly(df: DataFrame) -> DataFrame:
    """The hours that have rows are filled, and the empty ones repeat the hour before them. They are one row per hour, few
    enough for one window."""
    filled = ffill_bfill(hourly_means(df), bounded=True)
    w = Window.partitionBy(SITE).orderBy("ts")
    return every_hour(filled.withColumn("until", until_next(w))).select(SITE, "ts", "kw")


def hourly_series(df: DataFrame, least: int = 1) -> DataFrame:
    """Resample the sites that need it and leave the others as they are, over full histories; sites with fewer rows than
    `least` give none.

    One pass for all sites: a row per site and hour carries the mean and the hour's first and last row. Sites to resample go on
    with the mean, the others with the rows. Where such a site has an hour of more than two rows, these are read again.
    Every site that is left alone has at most 1.5 rows per hour or at most 24 rows, so windows by site are bounded.
    """
    sites = needs_resample(df).where(F.col("n") >= least)
    crowded = ~F.col("resample") & (F.col("most_in_hour") > 2)
    row = F.struct("ts", "kw")
    hours = df.groupBy(SITE, hour_of("ts").alias("hour")).agg(
        F.count("*").alias("rows"), F.avg("kw").alias("mean"), F.min(row).alias("first"), F.max(row).alias("last")
    )
    mean = F.struct(F.col("hour").alias("ts"), F.col("mean").alias("kw"))
    kept = F.when(F.col("resample"), F.array(mean)).when(F.col("rows") == 1, F.array("first")).otherwise(F.array("first", "last"))
    routed = hours.join(sites.where(~crowded).select(SITE, "resample"), SITE)
    routed = routed.select(SITE, "resample", F.explode(kept).alias("row")).select(SITE, "resample", "row.*")
    again = sites.where(crowded).select(SITE)
    if not again.isEmpty():
        rest = df.join(again, SITE, "left_semi").select(SITE, F.lit(False).alias("resample"), "ts", "kw")
        routed = routed.unionByName(rest)
    return _hourly_where_needed(routed)


def _hourly_where_needed(rows: DataFrame) -> DataFrame:
    """Fill and expand the sites whose rows are hours to `resample`; the rows of the others stay as they are."""
    flag = F.col("resample")
    ordered = Window.partitionBy(SITE).orderBy("ts")
    filled = LastKnown("filled").whole(rows.withColumn("filled", F.when(flag, F.col("kw"))), ordered)
    filled = filled.withColumns({
        "until": F.when(flag, until_next(ordered)).otherwise(F.col("ts")), "kw": F.when(flag, F.col("filled")).otherwise(F.col("kw")),
    })
    return every_hour(filled.drop("filled", "resample")).select(SITE, "ts", "kw")


def hourly_series_of_tail(df: DataFrame) -> DataFrame:
    """`hourly_series` for input already cut to the last N rows per site.

    After the cut the rows of a site are together and few, so the rule is a window over them, and both kinds of site go
    through one plan: the group key is the hour for sites to resample and the row itself for the others. Every step is
    keyed by site, so nothing is shuffled again and nothing is joined.
    """
    whole = Window.partitionBy(SITE)
    ordered = site_window(df)
    marked = df.select(SITE, "ts", "kw").withColumns({
        "n": F.count("*").over(whole),
        "hours": span_hours(F.min("ts").over(whole), F.max("ts").over(whole)),
        "row": F.row_number().over(ordered),
        "gap_s": gap_seconds(ordered),
    })
    short = F.coalesce(F.median("gap_s").over(whole) < SHORT_GAP_S, F.lit(False))
    marked = marked.withColumn("resample", too_dense(F.col("n"), F.col("hours")) | short)
    flag = F.col("resample")
    grouped = (
        marked.withColumns({"ts": F.when(flag, hour_of("ts")).otherwise(F.col("ts")), "row": F.when(flag, 0).otherwise(F.col("row"))})
        .groupBy(SITE, "resample", "ts", "row").agg(F.avg("kw").alias("kw"))
    )
    return _hourly_where_needed(grouped.drop("row"))


def hourly_profile(series: DataFrame) -> DataFrame:
    """Mean by hour of day as `profile`, an array indexed by hour + 1.

    Hours without rows take the default, everything is floored. An hour whose rows are all null gives NaN.
    """
    by_hour = series.groupBy(SITE, F.hour("ts").alias("hour")).agg(F.avg("kw").alias("mean"), F.max("ts").alias("last_ts"))
    means = F.map_from_entries(F.collect_list(F.struct("hour", F.coalesce("mean", F.lit(float("nan"))))))
    profile = F.transform(
        F.sequence(F.lit(0), F.lit(23)),
        lambda h: F.greatest(F.coalesce(F.try_element_at(F.col("means"), h), F.lit(PROFILE_DEFAULT)), F.lit(PROFILE_FLOOR)),
    )
    return (
        by_hour.groupBy(SITE).agg(means.alias("means"), F.max("last_ts").alias("last_ts"))
        .select(SITE, "last_ts", profile.alias("profile"))
    )


def profile_lookup(profile: Column | str, hour: Column, default: float = PROFILE_DEFAULT) -> Column:
    profile = F.col(profile) if isinstance(profile, str) else profile
    return F.coalesce(F.try_element_at(profile, (hour + 1).cast("int")), F.lit(default))


def history_array(series: DataFrame, keep: int, bounded: bool = False) -> DataFrame:
    """The last `keep` values of each site as `hist`, oldest first; nulls count as 0."""
    recent = last_n_rows(series.select(SITE, "ts", "kw"), keep, bounded)
    rows = F.sort_array(F.collect_list(F.struct("ts", null_to_zero("kw").alias("kw"))))
    return recent.groupBy(SITE).agg(rows.alias("rows")).select(SITE, F.transform("rows", lambda r: r["kw"]).alias("hist"))
