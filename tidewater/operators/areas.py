"""Managed-area geometry extents and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.semantics import null_safe_join, sorted_set

# Rank error of a quantile sketch is at most 1 / ACCURACY of its group.
ACCURACY = 20_000
SLACK = 2 / ACCURACY


def select_area(vertices: DataFrame, area: str, col: str = "area") -> DataFrame:
    return vertices.where(F.col(col) == area)


def area_bbox(vertices: DataFrame, by: str = "area") -> DataFrame:
    """Bounding box per area."""
    return vertices.groupBy(by).agg(
        F.min("lon").alias("xmin"),
        F.min("lat").alias("ymin"),
        F.max("lon").alias("xmax"),
        F.max("lat").alias("ymax"),
    )


def middle_edges(value: str) -> Column:
    """Aggregate: a bounded quantile sketch's values just below and above the middle."""
    return F.percentile_approx(value, F.array(F.lit(0.5 - SLACK), F.lit(0.5 + SLACK)), ACCURACY)


def exact_median(
    df: DataFrame, by: list[str], value: str, out: str = "Median", edges: DataFrame | None = None
) -> DataFrame:
    """Exact median per group without gathering a group in one task.

    ``percentile`` keeps all distinct values of a group in one buffer, which a
    group with a third of all rows would not fit.  Here bounded quantile
    sketches, merged from the map tasks, cut each group into a range below, a
    narrow one around and a range above its middle.  Exact row counts per range
    then tell which range holds the middle rank (the narrow one, unless a
    sketch was off, and then another one), and only that range is ranked.  The
    ranking reads its distinct values, at most 2 * SLACK of the group's rows.

    ``edges`` holds ``middle_edges`` per group as ``__edges`` where a caller's
    own aggregate has them already, which saves a scan.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    if edges is None:
        edges = rows.groupBy(*by).agg(middle_edges("__v").alias("__edges"))
    # Equal values always share a range: one comparison per edge.
    place = (F.col("__v") >= F.col("__edges")[0]).cast("int") + (F.col("__v") > F.col("__edges")[1]).cast("int")
    ranged = null_safe_join(rows, edges, by).select(*by, "__v", place.alias("__range"))
    sizes = ranged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__in"))
    group = W.partitionBy(*by)
    upto = group.orderBy("__range").rowsBetween(W.unboundedPreceding, W.currentRow)
    picked = (
        sizes.withColumn("__end", F.sum("__in").over(upto))
        .withColumn("__all", F.sum("__in").over(group))
        .withColumn("__lo", F.expr("(__all + 1) div 2"))
        .withColumn("__hi", F.expr("(__all + 2) div 2"))
        .withColumn("__before", F.col("__end") - F.col("__in"))
        .where("__before < __hi AND __end >= __lo")
        .select(*by, "__range", "__before", "__lo", "__hi")
    )
    middle = null_safe_join(ranged, picked, [*by, "__range"])
    middle = middle.groupBy(*by, "__range", "__before", "__lo", "__hi", "__v").agg(F.count(F.lit(1)).alias("__n"))
    within = W.partitionBy(*by, "__range").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = middle.withColumn("__last", F.col("__before") + F.sum("__n").over(within))
    at = "max(CASE WHEN __last - __n < {0} AND {0} <= __last THEN __v END)"
    halves = F.expr(f"({at.format('__lo')} + {at.format('__hi')}) / 2")
    return middle.groupBy(*by).agg(halves.alias(out))


def area_stats(
    df: DataFrame,
    areas: DataFrame,
    by: list[str],
    area: str = "ManagedAreaName",
    value: str = "ResultValue",
    year: str = "Year",
) -> DataFrame:
    """Statistics per area and group; areas without data stay, with no data counted.

    Years of the extremes belong to the area as a whole, the earliest one on
    ties.  The standard deviation is that of a sample.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(area).isNotNull())
    keys = [area, *by]
    # One scan gives all but the median; sets hold years and programs, not rows.
    profile = rows.groupBy(*keys).agg(
        F.size(F.collect_set(year)).cast("bigint").alias("N_Years"),
        F.min(year).alias("EarliestYear"),
        F.max(year).alias("LatestYear"),
        F.min(value).alias("Min"),
        F.max(value).alias("Max"),
        F.array_join(sorted_set("ProgramName"), ", ").alias("Programs"),
        F.array_join(F.transform(sorted_set("ProgramID"), lambda i: i.cast("string")), ", ").alias("ProgramIDs"),
        F.count(value).alias("N_Data"),
        F.avg(value).alias("Mean"),
        F.stddev_samp(value).alias("StandardDeviation"),
        F.min(F.struct(F.col(value), F.col(year))).alias("__lowest"),
        F.max(F.struct(F.col(value).alias("v"), (-F.col(year)).alias("y"))).alias("__highest"),
        middle_edges(value).alias("__edges"),
    )
    median = exact_median(rows, keys, value, edges=profile.select(*keys, "__edges"))
    whole = W.partitionBy(area)  # a row per group of the area
    out = profile.drop("__edges").withColumns(
        {
            "Year_MinRichness": F.min("__lowest").over(whole)[year],
            "Year_MaxRichness": -F.max("__highest").over(whole)["y"],
        }
    )
    out = null_safe_join(out.drop("__lowest", "__highest"), median, keys, "left")
    out = null_safe_join(areas.select(area).distinct(), out, [area], "left")
    zero = F.lit(0).cast("bigint")
    return out.withColumn("N_Years", F.coalesce("N_Years", zero)).withColumn("N_Data", F.coalesce("N_Data", zero))
