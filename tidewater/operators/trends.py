"""Trend classes, trendlines, plot series and trend-table views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.dates import decimal_year, trend_axis
from tidewater.functions.semantics import na_case
from tidewater.functions.text import interval_text, period_text
from tidewater.sources.constants import DECREASING, INCREASING, INSUFFICIENT, NO_FIT, NO_TREND

ALPHA = 0.05


def trend_text(p: Column, slope: Column, sufficient: Column, trend: Column) -> Column:
    """Trend in words from a significance test.

    Significance is inclusive.  An unknown condition leaves the class unknown,
    except that a missing trend always reads as insufficient data.
    """
    significant = p <= ALPHA
    tested = na_case(
        (significant & (slope > 0), INCREASING),
        (significant & (slope < 0), DECREASING),
        (~sufficient, INSUFFICIENT),
        (sufficient & slope.isNull(), NO_FIT),
        otherwise=NO_TREND,
    )
    return F.when(trend.isNull(), INSUFFICIENT).otherwise(tested)


def trend_class(df: DataFrame) -> DataFrame:
    out = trend_text(F.col("p"), F.col("SennSlope"), F.col("SufficientData"), F.col("Trend"))
    df = df.withColumn("Statistical Trend", out)
    if "LatestYear" in df.columns:
        df = df.withColumn("Period of Record", period_text(F.col("EarliestYear"), F.col("LatestYear")))
    return df


def interval_trend_text(est: Column, lo: Column, hi: Column, sufficient: Column, strict: bool = False) -> Column:
    """Trend in words from an estimate and its interval.

    There is a trend when both bounds lie strictly on the same side of zero;
    its direction is that of the estimate.  An undecidable row is null, or an
    error when ``strict``.
    """
    bad = F.raise_error(F.lit("interval bound or sufficiency flag is missing")).cast("string")
    unknown = bad if strict else F.lit(None).cast("string")
    no_estimate = F.when(sufficient.isNull(), unknown).when(sufficient, NO_FIT).otherwise(INSUFFICIENT)
    one_sided = ((lo < 0) & (hi < 0)) | ((lo > 0) & (hi > 0))
    direction = F.when(est > 0, INCREASING).otherwise(DECREASING)
    return (
        F.when(est.isNull(), no_estimate)
        .when(one_sided.isNull(), unknown)
        .when(one_sided, direction)
        .otherwise(NO_TREND)
    )


def interval_trend_class(df: DataFrame, strict: bool = False) -> DataFrame:
    est, lo, hi = F.col("ModelEstimate"), F.col("LowerConfidence"), F.col("UpperConfidence")
    return df.withColumn(
        "TrendStatus", interval_trend_text(est, lo, hi, F.col("SufficientData"), strict)
    ).withColumn("CredibleInterval", interval_text(lo, hi))


def sufficient_only(df: DataFrame) -> DataFrame:
    return df.where("SufficientData")


def trendline(df: DataFrame) -> DataFrame:
    """Start and end point of each fitted line; points that cannot be computed are dropped."""
    ends = F.array("EarliestSampleDate", "LastSampleDate")
    x = decimal_year("__day")
    return (
        df.withColumn("__day", F.explode(ends))
        .withColumn("x", x)
        .withColumn("y", (F.col("x") - F.col("EarliestYear")) * F.col("SennSlope") + F.col("SennIntercept"))
        .where(F.col("y").isNotNull())
        .drop("__day")
    )


def series(df: DataFrame, station, parameter: str) -> DataFrame:
    """Monthly means of one station and parameter in time order."""
    return df.where((F.col("ProgramLocationID") == station) & (F.col("ParameterName") == parameter)).orderBy(
        "YearMonthDec"
    )


def series_axes(df: DataFrame) -> DataFrame:
    """Extent, limits and ticks of every station's and parameter's series."""
    out = df.groupBy("ProgramLocationID", "ParameterName").agg(
        F.min("Year").alias("t_min"), F.max("YearMonthDec").alias("t_max"), F.min("Mean").alias("min_mean")
    )
    return out.select("*", trend_axis(F.col("t_min"), F.col("t_max")).alias("__axis")).select(
        *out.columns, "__axis.*"
    )


def species_trends(df: DataFrame) -> DataFrame:
    """Species trend view with its period of record."""
    period = period_text(F.col("EarliestYear"), F.col("LatestYear"))
    return df.withColumn("Period of Record", period).select(
        "ManagedAreaName", "Species", "StatisticalTrend", "Period of Record", "LME_Intercept", "LME_Slope", "p"
    )


def interval_trends(df: DataFrame, strict: bool = False) -> DataFrame:
    """Interval trend view with trend status and interval text."""
    return interval_trend_class(df, strict).select(
        "ManagedAreaName", "ParameterName", "ShellType", "HabitatType", "SizeClass",
        "TrendStatus", "ModelEstimate", "StandardError", "CredibleInterval",
    )


# Plot type, parameter; any other plot type shows "Percent Live".
PLOT_PARAMETER = {"Oyster_Dens": "Density", "Oyster_SH": "Shell Height"}


def interval_trend_view(df: DataFrame, area: str, plot_type: str) -> DataFrame:
    """Rows of one area for a plot type, under display names.

    The size plot needs a size class (a blank one may have been read as null)
    and shows no habitat type; the other plots show no size class.
    """
    rows = df.where(
        (F.col("ManagedAreaName") == area)
        & (F.col("ParameterName") == PLOT_PARAMETER.get(plot_type, "Percent Live"))
    )
    if plot_type == "Oyster_SH":
        rows = rows.where(F.coalesce("SizeClass", F.lit("")) != "")
        group = F.col("SizeClass").alias("Size Class")
    else:
        group = F.col("HabitatType").alias("Habitat Type")
    return rows.select(
        F.col("ShellType").alias("Shell Type"),
        group,
        F.col("TrendStatus").alias("Trend Status"),
        F.col("ModelEstimate").alias("Estimate"),
        F.col("StandardError").alias("Standard Error"),
        F.col("CredibleInterval").alias("Credible Interval"),
    )


def trend_table(tables: dict[str, DataFrame], habitat: str, area: str, plot_type: str) -> DataFrame | None:
    """Trend table of a habitat; habitats without one give None."""
    if habitat not in tables:
        return None
    if habitat == "Oyster Reef":
        return interval_trend_view(tables[habitat], area, plot_type)
    return tables[habitat].where(F.col("ManagedAreaName") == area).drop("ManagedAreaName")
