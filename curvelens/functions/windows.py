"""Window expressions over a series ordered by step; every order is total."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from curvelens.model import SERIES, finite


def by_step(keys: list[str] | None = None, order: tuple[str, ...] = ("step",)) -> WindowSpec:
    return Window.partitionBy(*(keys or SERIES)).orderBy(*order)


def island(value: Column, w: WindowSpec) -> Column:
    """Number of unusable rows so far: equal for the finite rows of one segment."""
    return F.sum(F.when(finite(value), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def trailing_median(value: Column, n: int, w: WindowSpec) -> Column:
    return F.percentile(value, F.lit(0.5)).over(w.rowsBetween(1 - n, Window.currentRow))


def centred_median(value: Column, n: int, w: WindowSpec) -> Column:
    return F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-(n // 2), n // 2))


def median_of(values: Column) -> Column:
    """Exact median of an array: the mean of the middle two."""
    ordered, n = F.array_sort(values), F.size(values)
    return F.get(F.transform(F.array(ordered), lambda a: (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2), F.lit(0))


def rolling_mad(value: Column, n: int, w: WindowSpec) -> Column:
    """Median of distances from each trailing window's own median."""
    held = F.collect_list(value).over(w.rowsBetween(1 - n, Window.currentRow))
    about = lambda m: median_of(F.transform(held, lambda x: F.abs(x - m)))
    return F.get(F.transform(F.array(median_of(held)), about), F.lit(0))


def robust_z(value: Column, n: int, w: WindowSpec) -> Column:
    return 0.6745 * (value - trailing_median(value, n, w)) / F.greatest(rolling_mad(value, n, w), F.lit(1e-12))


def centred_median_of(values: Column, width: Column) -> Column:
    """Centred medians of an array for a width that depends on the data; ends shrink."""
    half = F.floor(width / 2).cast("int")
    n = F.size(values)
    at = lambda i: median_of(F.slice(values, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, n - 1) - F.greatest(i - half, F.lit(0)) + 1))
    return F.transform(F.sequence(F.lit(0), n - 1), at)


def forward_extrema(value: Column, n: int, w: WindowSpec) -> tuple[Column, Column, Column]:
    """Minimum and maximum of n rows from here on, and how many there are."""
    ahead = w.rowsBetween(Window.currentRow, n - 1)
    return F.min(value).over(ahead), F.max(value).over(ahead), F.count(value).over(ahead)


def session(position: Column, gap: int, w: WindowSpec) -> Column:
    """Group number of rows whose positions follow each other by at most `gap`."""
    return F.when(position - F.lag(position).over(w) > gap, 1).otherwise(0)


def moments(x: Column, y: Column, n: int, w: WindowSpec) -> dict[str, Column]:
    ahead = w.rowsBetween(Window.currentRow, n - 1)
    return {"sxx": F.regr_sxx(y, x).over(ahead), "syy": F.regr_syy(y, x).over(ahead), "sxy": F.regr_sxy(y, x).over(ahead), "n": F.regr_count(y, x).over(ahead)}


def flat_constant(n: int, alpha: float) -> float:
    """A slope over n rows is flat at level alpha if Sxy**2 <= c * Sxx * Syy."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(alpha / 2)
    return z * z / (n - 2 + z * z)
