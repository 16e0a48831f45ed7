"""Year-coverage segments and active/historical status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.dates import status_of


def year_gaps(df: DataFrame, keys: list[str], year: str = "Year") -> DataFrame:
    """Distinct years per group with the distance to the next one (null at the end)."""
    years = df.where(F.col(year).isNotNull()).select(*keys, F.col(year).cast("int").alias(year)).distinct()
    ahead = F.lead(year).over(W.partitionBy(*keys).orderBy(year))
    return years.withColumn("gap", ahead - F.col(year))


def year_segments(df: DataFrame, keys: list[str], year: str = "Year", mode: str = "reference") -> DataFrame:
    """(startYear, endYear) segments per group; rows without a year are ignored.

    ``mode='islands'`` gives the maximal runs of consecutive years.

    ``mode='reference'`` (default) gives the table that existing dashboards
    show.  There, a run that is followed by a gap ends one year *before* its
    last year, and the next segment starts one year *after* that last year, so
    an isolated year before a gap yields an inverted segment.  Both modes give
    the same number of segments.

    The observations are reduced to distinct (group, year) with map-side
    aggregation before the windows, so a window partition holds at most one row
    per calendar year however many observations the group has; all windows and
    the island aggregate share one exchange on the group.
    """
    if mode == "islands":
        years = df.where(F.col(year).isNotNull()).select(*keys, F.col(year).cast("int").alias("__y")).distinct()
        run = F.col("__y") - F.row_number().over(W.partitionBy(*keys).orderBy("__y"))
        islands = years.withColumn("__run", run).groupBy(*keys, "__run")
        return islands.agg(F.min("__y").alias("startYear"), F.max("__y").alias("endYear")).drop("__run")
    if mode != "reference":
        raise ValueError("mode is 'reference' or 'islands'")
    in_order = W.partitionBy(*keys).orderBy(year)
    first = F.min(year).over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow))
    breaks = (
        year_gaps(df, keys, year)
        .withColumn("__first", first)
        .where(F.col("gap").isNull() | (F.col("gap") != 1))
    )
    previous = F.lag(year).over(in_order)
    return breaks.select(
        *keys,
        F.coalesce(previous + 1, F.col("__first")).alias("startYear"),
        F.when(F.col("gap").isNull(), F.col(year)).otherwise(F.col(year) - 1).alias("endYear"),
    )


def with_status(df: DataFrame, year_col: str, as_of, per: list[str] | None = None) -> DataFrame:
    """Add ``Status`` from a year column, or from its maximum over the group ``per``.

    Within a group one missing year makes the status of the group missing.
    """
    year = F.col(year_col)
    if per:
        group = W.partitionBy(*per)
        whole = F.count(year).over(group) == F.count(F.lit(1)).over(group)
        year = F.when(whole, F.max(year_col).over(group))
    return df.withColumn("Status", status_of(year, as_of))


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key under a total order.

    Spark limits each map task to its own first row per key before the shuffle
    (window group limit), so a hot key ships one row per task.
    """
    by = W.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") == 1).drop("__rank")
