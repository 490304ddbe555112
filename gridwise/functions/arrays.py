"""Array column expressions for histories and forecasts held in one row per site."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pad_to(values: Column, length: int) -> Column:
    """Pad with the last value (0 when empty) and cut to `length`."""
    last = F.when(F.size(values) > 0, F.element_at(values, -1)).otherwise(F.lit(0.0))
    missing = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    return F.slice(F.concat(values, F.array_repeat(last, missing)), 1, length)


def left_pad_first(values: Column, length: int) -> Column:
    """Keep the last `length` values, padded on the left with the first one; zeros when empty."""
    first = F.when(F.size(values) > 0, F.element_at(values, 1)).otherwise(F.lit(0.0))
    missing = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    return tail(F.concat(F.array_repeat(first, missing), values), length)


def append_value(values: Column, value: Column, keep: int | None = None) -> Column:
    out = F.concat(values, F.array(value))
    return out if keep is None else tail(out, keep)


def tail(values: Column, length: int) -> Column:
    """The last `length` values, or all of them when there are fewer."""
    start = F.greatest(F.size(values) - length + 1, F.lit(1))
    return F.slice(values, start, F.lit(length))


def neg_index(values: Column, k: int, first: Column | None = None) -> Column:
    """`values[-k]`, or the first value while the array is shorter than `k`."""
    first = F.element_at(values, 1) if first is None else first
    return F.when(F.size(values) >= k, F.element_at(values, -k)).otherwise(first)


def mean_of(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def std_pop_of(values: Column) -> Column:
    """Population standard deviation; the recursion uses this one, the feature table the sample one."""
    # The one-element transform binds the mean once instead of once per element.
    squares = F.transform(
        F.array(mean_of(values)),
        lambda mean: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)),
    )
    return F.when(F.size(values) > 1, F.sqrt(F.element_at(squares, 1) / F.size(values))).otherwise(0.0)
