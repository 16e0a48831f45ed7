"""Trend decision tables, trendlines and trend views."""

import itertools

import pytest
from pyspark.sql import functions as F

from tidewater.operators import trends
from tidewater.sources.constants import DECREASING, INCREASING, INSUFFICIENT, NO_FIT, NO_TREND


def and3(a, b):
    if a is False or b is False:
        return False
    return None if a is None or b is None else True


def compare(x, f):
    return None if x is None else f(x)


def expected_class(p, slope, sufficient, trend):
    if trend is None:
        return INSUFFICIENT
    significant = compare(p, lambda v: v <= 0.05)
    for sign, name in ((1, INCREASING), (-1, DECREASING)):
        c = and3(significant, compare(slope, lambda v: v * sign > 0))
        if c is None:
            return None
        if c:
            return name
    if sufficient is None:
        return None
    if not sufficient:
        return INSUFFICIENT
    return NO_FIT if slope is None else NO_TREND


def test_every_pattern_of_the_test_based_class(spark):
    cases = list(itertools.product([0.01, 0.05, 0.0500001, None], [1.0, -1.0, 0.0, None], [True, False, None], [1, None]))
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)], "i int, p double, SennSlope double, SufficientData boolean, Trend int"
    )
    got = dict(trends.trend_class(df).select("i", "Statistical Trend").collect())
    assert got == {i: expected_class(*c) for i, c in enumerate(cases)}
    assert set(got.values()) == {INCREASING, DECREASING, INSUFFICIENT, NO_FIT, NO_TREND, None}


def intervals(spark, cases):
    return spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)],
        "i int, ModelEstimate double, LowerConfidence double, UpperConfidence double, SufficientData boolean",
    )


@pytest.mark.parametrize("est,lo,hi,ok,want", [
    (1.0, 0.5, 2.0, True, INCREASING), (-1.0, -2.0, -0.5, True, DECREASING), (1.0, -0.5, 2.0, True, NO_TREND),
    (1.0, 0.0, 2.0, True, NO_TREND), (0.0, 0.5, 2.0, False, DECREASING), (None, 1.0, 2.0, True, NO_FIT),
    (None, None, None, False, INSUFFICIENT), (1.0, -1.0, 0.0, None, NO_TREND),
])
def test_interval_class(spark, est, lo, hi, ok, want):
    df = intervals(spark, [(est, lo, hi, ok)])
    assert trends.interval_trend_class(df).first()["TrendStatus"] == want
    assert trends.interval_trend_class(df, strict=True).first()["TrendStatus"] == want


@pytest.mark.parametrize("case", [(1.0, None, 2.0, True), (1.0, None, None, True), (None, 1.0, 1.0, None)])
def test_undecidable_interval(spark, case):
    df = intervals(spark, [case])
    assert trends.interval_trend_class(df).first()["TrendStatus"] is None
    with pytest.raises(Exception, match="missing"):
        trends.interval_trend_class(df, strict=True).collect()


def test_trendline(spark):
    df = spark.createDataFrame(
        [("m1", "2000-01-01", "2002-01-01", 2000, 0.5, 1.0), ("m2", "2000-01-01", "2001-01-01", 2000, None, 1.0)],
        "MonitoringID string, a string, b string, EarliestYear int, SennSlope double, SennIntercept double",
    ).withColumns({"EarliestSampleDate": F.to_date("a"), "LastSampleDate": F.to_date("b")})
    got = [tuple(r) for r in trends.trendline(df).orderBy("x").select("MonitoringID", "x", "y").collect()]
    assert got == [("m1", 2000.0, 1.0), ("m1", 2002.0, 2.0)]


def test_series(spark):
    df = spark.createDataFrame(
        [("s", "DO", 2001, 2001.5, 3.0), ("s", "DO", 2000, 2000.25, 2.0), ("s", "pH", 2000, 2000.5, 9.0), ("t", "DO", 1990, 1990.0, 1.0)],
        "ProgramLocationID string, ParameterName string, Year int, YearMonthDec double, Mean double",
    )
    assert [r["Mean"] for r in trends.series(df, "s", "DO").collect()] == [2.0, 3.0]
    axes = {(r[0], r[1]): r for r in trends.series_axes(df).collect()}
    assert (axes["s", "DO"]["step"], axes["s", "DO"]["axis_lo"], axes["s", "DO"]["ticks"]) == (1, 1998.75, [2002, 2001, 2000, 1999])


@pytest.fixture(scope="module")
def trend_tables(spark):
    rows = [
        ("Bay", "Shell Height", "Live", "Natural", None, 1.0, 0.1, 0.5, 1.5, True),
        ("Bay", "Shell Height", "Live", "Natural", "", 1.0, 0.1, 0.5, 1.5, True),
        ("Bay", "Shell Height", "Live", "Natural", "25-75mm", 1.0, 0.1, 0.126, 1.5, True),
        ("Bay", "Density", "Live", "Natural", None, -1.0, 0.1, -2.0, -0.5, True),
        ("Bay", "Percent Live", "Live", "Natural", None, None, None, None, None, False),
        ("Cape", "Density", "Live", "Natural", None, 1.0, 0.1, -1.0, 2.0, True),
    ]
    df = spark.createDataFrame(
        rows, "ManagedAreaName string, ParameterName string, ShellType string, HabitatType string, SizeClass string, "
        "ModelEstimate double, StandardError double, LowerConfidence double, UpperConfidence double, SufficientData boolean",
    )
    species = spark.createDataFrame(
        [("Bay", "Turtle grass", "t", 2000, None, 1.0, 0.1, 0.5)],
        "ManagedAreaName string, Species string, StatisticalTrend string, EarliestYear int, LatestYear int, "
        "LME_Intercept double, LME_Slope double, p double",
    )
    return {"Oyster Reef": trends.interval_trends(df), "Submerged Aquatic Vegetation": trends.species_trends(species)}


def test_trend_tables(trend_tables):
    size = trends.trend_table(trend_tables, "Oyster Reef", "Bay", "Oyster_SH")
    assert size.columns == ["Shell Type", "Size Class", "Trend Status", "Estimate", "Standard Error", "Credible Interval"]
    assert [tuple(r) for r in size.collect()] == [("Live", "25-75mm", INCREASING, 1.0, 0.1, "0.13 to 1.5")]
    density = trends.trend_table(trend_tables, "Oyster Reef", "Bay", "Oyster_Dens")
    assert density.columns[1] == "Habitat Type"
    assert [r["Trend Status"] for r in density.collect()] == [DECREASING]
    live = trends.trend_table(trend_tables, "Oyster Reef", "Bay", "Oyster_PrcLive").collect()
    assert [(r["Trend Status"], r["Credible Interval"]) for r in live] == [(INSUFFICIENT, "NA to NA")]
    sav = trends.trend_table(trend_tables, "Submerged Aquatic Vegetation", "Bay", "multiplot")
    assert "ManagedAreaName" not in sav.columns and sav.first()["Period of Record"] == "2000 - NA"
    assert trends.trend_table(trend_tables, "Nekton", "Bay", "x") is None
