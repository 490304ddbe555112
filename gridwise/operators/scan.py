"""Running values that depend on all rows before: averages and last known values, over whole or cut-up sites.

A scan has two levels. Within a block of a site, each row gets the step that leads from the block's start to it. A block is
then summed up in one row; these rows are composed in block order, which gives the state at each block's start, and the
state is joined back. Steps compose to steps of the same kind, so the result does not depend on where a site is cut, and
nothing but one row per block goes from one block to the next.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from gridwise.schemas import SITE

# Weights below this no longer change a double, so a step reaches back no further within a block.
SMALLEST_WEIGHT = 1e-17
BLOCK = [SITE, "block"]
# Steps joined with one window over the rows of a block.
FOLD = 4


class Scan(Protocol):
    """Adds columns to whole sites, or to blocks of sites in `pos` order, at most `most` of them in a site."""

    def whole(self, df: DataFrame, w: WindowSpec) -> DataFrame: ...

    def blocks(self, df: DataFrame, most: int) -> DataFrame: ...


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def earlier(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Averages:
    """Exponential moving averages `<column>_ema_<span>`: y = x at the first reading, then y = c y_prev + (1 - c) x.

    With a = 2 / (span + 1) and a reading g rows after the one before, c is (1 - a)^g / ((1 - a)^g + a), which is 1 - a
    where no row is missing. Rows without a reading keep the last average; before the first reading there is none.

    Each reading is an affine step, and steps one after the other are one again, so that `FOLD` times as many are joined with
    each window over the rows, where a frame would visit every row of the history for each row. A block is one step from the
    average before it to the average after it; blocks without a reading change nothing.
    """

    column: str
    spans: tuple[int, ...]

    def name(self, span: int) -> str:
        return f"{self.column}_ema_{span}"

    def kept(self, span: int, gap: Column) -> Column:
        """The weight of the average before, `gap` rows after the reading before."""
        a = 2.0 / (span + 1)
        left = F.pow(F.lit(1 - a), gap)
        return F.when(gap == 1, F.lit(1 - a)).otherwise(left / (left + a))

    def steps(self, df: DataFrame, keys: list[str], row: str) -> DataFrame:
        """`ema_c_*`, `ema_d_*`: the step from the first reading of a group to each reading of it."""
        value = F.col(self.column)
        # Readings alone, so that a lag is the reading before; they stay in the partitions of the group.
        readings = Window.partitionBy(*keys, F.isnull(self.column)).orderBy(row)
        df = df.withColumn("ema_gap", F.col(row) - F.lag(row).over(readings))
        first = F.col("ema_gap").isNull()
        df = df.withColumns({f"ema_c_{s}": F.when(first, 1.0).otherwise(self.kept(s, F.col("ema_gap"))) for s in self.spans})
        df = df.withColumns({f"ema_d_{s}": (1 - F.col(f"ema_c_{s}")) * value for s in self.spans})
        reach = 1
        while any((1 - 2.0 / (s + 1)) ** reach > SMALLEST_WEIGHT for s in self.spans):
            df = folded(df, [s for s in self.spans if (1 - 2.0 / (s + 1)) ** reach > SMALLEST_WEIGHT], readings, reach)
            reach *= FOLD
        return df

    def drop(self, df: DataFrame, *more: str) -> DataFrame:
        return df.drop("ema_gap", *[f"ema_{x}_{s}" for x in "cd" for s in self.spans], *more)

    def whole(self, df: DataFrame, w: WindowSpec) -> DataFrame:
        df = self.steps(df.withColumn("ema_row", F.row_number().over(w)), [SITE], "ema_row")
        first = F.first(self.column, ignorenulls=True).over(upto(w))
        own = {
            s: F.when(F.col(self.column).isNotNull(), F.col(f"ema_c_{s}") * F.col("ema_first") + F.col(f"ema_d_{s}")) for s in self.spans
        }
        df = df.withColumn("ema_first", first)
        df = df.withColumns({self.name(s): F.last(y, ignorenulls=True).over(upto(w)) for s, y in own.items()})
        return self.drop(df, "ema_row", "ema_first")

    def blocks(self, df: DataFrame, most: int) -> DataFrame:
        df = self.steps(df, BLOCK, "pos")
        reading = F.col(self.column).isNotNull()
        at = F.when(reading, F.col("pos"))
        ends = [F.max_by(f"ema_{x}_{s}", at).alias(f"ema_{x}_{s}") for x in "cd" for s in self.spans]
        summary = df.groupBy(*BLOCK).agg(
            F.min_by(self.column, at).alias("ema_first"), F.min(at).alias("ema_from"), F.max(at).alias("ema_to"), *ends
        )
        state = self.starts(summary, most)
        within = Window.partitionBy(*BLOCK).orderBy("pos")
        joined = df.join(state, BLOCK)
        own = {s: F.when(reading, F.col(f"ema_c_{s}") * F.col(f"ema_y_{s}") + F.col(f"ema_d_{s}")) for s in self.spans}
        kept = {
            self.name(s): F.coalesce(F.last(y, ignorenulls=True).over(upto(within)), F.col(f"ema_in_{s}")) for s, y in own.items()
        }
        return self.drop(joined.withColumns(kept), *[f"ema_{x}_{s}" for x in ("y", "in") for s in self.spans])

    def starts(self, summary: DataFrame, most: int) -> DataFrame:
        """Per block: `ema_in_*`, the averages before it, and `ema_y_*`, those at its first reading."""
        order = Window.partitionBy(SITE).orderBy("block")
        summary = summary.withColumn("ema_gap", F.col("ema_from") - F.last("ema_to", ignorenulls=True).over(earlier(order)))
        # From the average before a block to that at its first reading; the very first reading starts anew.
        weight = {s: F.when(F.col("ema_gap").isNull(), 0.0).otherwise(self.kept(s, F.col("ema_gap"))) for s in self.spans}
        summary = summary.withColumns({f"ema_w_{s}": w for s, w in weight.items()})
        empty = F.col("ema_from").isNull()
        whole = {}
        for s in self.spans:
            c, d, w = F.col(f"ema_c_{s}"), F.col(f"ema_d_{s}"), F.col(f"ema_w_{s}")
            whole[f"ema_c_{s}"] = F.when(empty, 1.0).otherwise(c * w)
            whole[f"ema_d_{s}"] = F.when(empty, 0.0).otherwise(c * (1 - w) * F.col("ema_first") + d)
        summary = summary.withColumns(whole)
        for k in range(max(most - 1, 0).bit_length()):
            summary = summary.withColumns(composed(self.spans, order, 1 << k, lambda s: True))
        begun = F.last("ema_to", ignorenulls=True).over(earlier(order)).isNotNull()
        summary = summary.withColumns({f"ema_in_{s}": F.when(begun, F.lag(f"ema_d_{s}").over(order)) for s in self.spans})
        first = {}
        for s in self.spans:
            w = F.col(f"ema_w_{s}")
            first[f"ema_y_{s}"] = w * F.coalesce(f"ema_in_{s}", F.lit(0.0)) + (1 - w) * F.col("ema_first")
        return summary.withColumns(first).select(*BLOCK, *[f"ema_{x}_{s}" for x in ("in", "y") for s in self.spans])


def composed(spans: tuple[int, ...], w: WindowSpec, reach: int, wanted) -> dict[str, Column]:
    """Each row's step after the step of the row `reach` before; rows before the first change nothing."""
    out = {}
    for s in filter(wanted, spans):
        c, d = F.col(f"ema_c_{s}"), F.col(f"ema_d_{s}")
        out[f"ema_d_{s}"] = d + c * F.coalesce(F.lag(d, reach).over(w), F.lit(0.0))
        out[f"ema_c_{s}"] = c * F.coalesce(F.lag(c, reach).over(w), F.lit(1.0))
    return out


def folded(df: DataFrame, spans: list[int], w: WindowSpec, reach: int) -> DataFrame:
    """Each row's step after those of the rows `reach`, 2 `reach`, ... before, `FOLD` in all."""
    lags = {f"ema_{x}_{s}_{k}": F.lag(f"ema_{x}_{s}", k * reach).over(w) for k in range(1, FOLD) for s in spans for x in "cd"}
    out = {}
    for s in spans:
        c, d = F.col(f"ema_c_{s}"), F.col(f"ema_d_{s}")
        for k in range(1, FOLD):
            d = d + c * F.coalesce(f"ema_d_{s}_{k}", F.lit(0.0))
            c = c * F.coalesce(f"ema_c_{s}_{k}", F.lit(1.0))
        out |= {f"ema_c_{s}": c, f"ema_d_{s}": d}
    return df.withColumns(lags).withColumns(out).drop(*lags)


def readings_reached(spans: list[int]) -> int:
    """Readings back after which the longest span's weight no longer changes a double."""
    return math.ceil(math.log(SMALLEST_WEIGHT) / math.log(1 - 2 / (max(spans) + 1)))


@dataclass(frozen=True)
class LastKnown:
    """Fill nulls of `column` with the last value before them, and those at a site's start with its first value.

    Two blocks one after the other are known by the later last value and the earlier first one.
    """

    column: str

    def whole(self, df: DataFrame, w: WindowSpec) -> DataFrame:
        forward = F.last(self.column, ignorenulls=True).over(upto(w))
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumn(self.column, F.coalesce(forward, F.first(self.column, ignorenulls=True).over(every)))

    def blocks(self, df: DataFrame, most: int) -> DataFrame:
        at = F.when(F.col(self.column).isNotNull(), F.col("pos"))
        summary = df.groupBy(*BLOCK).agg(
            F.min_by(self.column, at).alias("known_first"), F.max_by(self.column, at).alias("known_last")
        )
        order = Window.partitionBy(SITE).orderBy("block")
        every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        state = summary.select(
            *BLOCK,
            F.last("known_last", ignorenulls=True).over(earlier(order)).alias("known_before"),
            F.first("known_first", ignorenulls=True).over(every).alias("known_first"),
        )
        forward = F.last(self.column, ignorenulls=True).over(upto(Window.partitionBy(*BLOCK).orderBy("pos")))
        return df.join(state, BLOCK).withColumn(
            self.column, F.coalesce(forward, "known_before", "known_first")
        ).drop("known_before", "known_first")
