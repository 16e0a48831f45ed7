"""Calendar-year rules, fractional years and axis ticks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.semantics import as_col

ACTIVE, HISTORICAL = "Active", "Historical"


def cutoff_year(as_of: str | dt.date | Column) -> Column:
    """Calendar year of ``as_of`` minus one year (29 February clamps to the 28th)."""
    day = as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")
    return F.year(F.add_months(day, -12))


def status_of(year: Column, as_of) -> Column:
    """Active when ``year`` reaches the cut-off year; unknown year, unknown status."""
    return F.when(year.isNull(), F.lit(None)).when(year >= cutoff_year(as_of), ACTIVE).otherwise(HISTORICAL)


def decimal_year(day: Column | str) -> Column:
    """Date as year plus elapsed fraction of that year."""
    d = as_col(day).cast("date")
    length = F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))
    return F.year(d) + (F.dayofyear(d) - 1) / length


def tick_step(span: Column) -> Column:
    """Years between ticks for a time axis of ``span`` years."""
    return F.when(span >= 30, 10).when(span >= 10, 4).when(span >= 4, 2).when(span < 4, 1)


def descending_ticks(hi: Column, lo: Column, step: Column | int) -> Column:
    """``hi, hi-step, ...`` down to ``lo``; null when the range is inverted."""
    step = F.lit(step) if isinstance(step, int) else step
    return F.when(hi >= lo, F.sequence(hi.cast("int"), lo.cast("int"), -step.cast("int")))


def coverage_ticks(lo: Column, hi: Column) -> Column:
    return descending_ticks(hi, lo, 2)


def trend_axis(lo: Column, hi: Column) -> Column:
    """Limits and ticks of a trend plot from first year and last fractional year.

    Spans under two years are widened by a year on each side; the first tick is
    the (half-even) rounded end of the data, before any widening.
    """
    span = hi - lo
    widen = F.when(span < 2, 1).otherwise(0)
    step = tick_step(span)
    first = F.bround(hi, 0).cast("int")
    return F.struct(
        (lo - widen - F.lit(0.25)).alias("axis_lo"),
        (hi + widen + F.lit(0.25)).alias("axis_hi"),
        step.alias("step"),
        descending_ticks(first, lo - widen, step).alias("ticks"),
    )
