"""Trend classes, trendlines and series."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog import query
from tidewater.operators import trends
from tidewater.plans import continuous

ROWS = X.with_(X.TREND_ROWS)
INTERVALS = X.with_(X.INTERVALS)


@query("o90_trend_class", ROWS + """
SELECT MonitoringID, p, SennSlope, EarliestYear || ' - ' || LatestYear AS "Period of Record",
  CASE WHEN Trend IS NULL THEN 'Insufficient data to calculate trend'
       WHEN (p <= 0.05 AND SennSlope > 0) IS NULL THEN NULL
       WHEN p <= 0.05 AND SennSlope > 0 THEN 'Significantly increasing trend'
       WHEN (p <= 0.05 AND SennSlope < 0) IS NULL THEN NULL
       WHEN p <= 0.05 AND SennSlope < 0 THEN 'Significantly decreasing trend'
       WHEN NOT SufficientData THEN 'Insufficient data to calculate trend'
       WHEN SennSlope IS NULL THEN 'Model did not fit the available data'
       ELSE 'No significant trend' END AS "Statistical Trend"
FROM trend_rows""")
def trend_class(spark, sf):
    out = trends.trend_class(X.trend_rows(spark, sf))
    return out.select("MonitoringID", "p", "SennSlope", "Period of Record", "Statistical Trend")


_INTERVAL_CLASS = """CASE WHEN ModelEstimate IS NULL AND SufficientData THEN 'Model did not fit the available data'
       WHEN ModelEstimate IS NULL THEN 'Insufficient data to calculate trend'
       WHEN ((LowerConfidence < 0 AND UpperConfidence < 0) OR (LowerConfidence > 0 AND UpperConfidence > 0)) IS NULL THEN NULL
       WHEN (LowerConfidence < 0 AND UpperConfidence < 0) OR (LowerConfidence > 0 AND UpperConfidence > 0)
       THEN CASE WHEN ModelEstimate > 0 THEN 'Significantly increasing trend' ELSE 'Significantly decreasing trend' END
       ELSE 'No significant trend' END"""


@query("o91_interval_trend_class", INTERVALS + f"SELECT id, ModelEstimate, {_INTERVAL_CLASS} AS TrendStatus FROM intervals")
def interval_trend_class(spark, sf):
    return trends.interval_trend_class(X.intervals(spark, sf)).select("id", "ModelEstimate", "TrendStatus")


_DECIMAL = "year({0}) + (dayofyear({0}) - 1) / dayofyear(make_date(year({0}), 12, 31))::DOUBLE"


@query("o92_trendline", ROWS + f""", ends AS (
  SELECT *, unnest([EarliestSampleDate, LastSampleDate]) AS d FROM trend_rows),
xy AS (SELECT MonitoringID, EarliestYear, SennSlope, SennIntercept, {_DECIMAL.format('d')} AS x FROM ends)
SELECT MonitoringID, round(x, 6) AS x, round((x - EarliestYear) * SennSlope + SennIntercept, 6) AS y
FROM xy WHERE SennSlope IS NOT NULL""")
def trendline(spark, sf):
    out = trends.trendline(X.trend_rows(spark, sf)).orderBy("MonitoringID", "x")
    return out.select("MonitoringID", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("o93_series", X.with_(X.MONTHLY) + """
SELECT ProgramLocationID, ParameterName, Year, round(YearMonthDec, 6) AS YearMonthDec, round(Mean, 6) AS Mean
FROM monthly WHERE ProgramLocationID = 1 AND ParameterName = 'LARGE'""")
def series(spark, sf):
    out = trends.series(X.monthly(spark, sf), 1, "LARGE")
    return out.withColumns({"YearMonthDec": F.round("YearMonthDec", 6), "Mean": F.round("Mean", 6)})


@query("o93_series_axes", X.with_(X.MONTHLY) + """, e AS (
  SELECT ProgramLocationID, ParameterName, min(Year) AS t_min, max(YearMonthDec) AS t_max, min(Mean) AS min_mean
  FROM monthly GROUP BY ALL),
s AS (SELECT *, CASE WHEN t_max - t_min < 2 THEN 1 ELSE 0 END AS widen,
             CASE WHEN t_max - t_min >= 30 THEN 10 WHEN t_max - t_min >= 10 THEN 4
                  WHEN t_max - t_min >= 4 THEN 2 ELSE 1 END AS step FROM e)
SELECT ProgramLocationID, ParameterName, t_min, round(t_max, 6) AS t_max, round(min_mean, 6) AS min_mean, step,
       round(t_min - widen - 0.25::DOUBLE, 6) AS axis_lo, round(t_max + widen + 0.25::DOUBLE, 6) AS axis_hi,
       array_to_string(range(CAST(round_even(t_max, 0) AS INTEGER), t_min - widen - 1, -step), ', ') AS ticks
FROM s""")
def series_axes(spark, sf):
    out = trends.series_axes(X.monthly(spark, sf))
    rounded = {c: F.round(c, 6) for c in ("t_max", "min_mean", "axis_lo", "axis_hi")}
    return out.withColumns({**rounded, "ticks": F.concat_ws(", ", F.col("ticks").cast("array<string>"))})


@query("o94_sufficient_rows", ROWS + "SELECT MonitoringID, N_Years FROM trend_rows WHERE SufficientData")
def sufficient_rows(spark, sf):
    return trends.sufficient_only(X.trend_rows(spark, sf)).select("MonitoringID", "N_Years")


@query("o95_species_trends", ROWS + """
SELECT ProgramLocationID AS ManagedAreaName, ParameterName AS Species, MonitoringID AS StatisticalTrend,
       EarliestYear || ' - ' || LatestYear AS "Period of Record", SennIntercept AS LME_Intercept, SennSlope AS LME_Slope, p
FROM trend_rows""")
def species_trends(spark, sf):
    rows = X.trend_rows(spark, sf).withColumnsRenamed({
        "ProgramLocationID": "ManagedAreaName", "ParameterName": "Species", "MonitoringID": "StatisticalTrend",
        "SennIntercept": "LME_Intercept", "SennSlope": "LME_Slope",
    })
    return trends.species_trends(rows)




def _bound(x):
    return f"CASE WHEN {x} IS NULL THEN 'NA' ELSE regexp_replace(CAST({X.r_round(x, 2)} + 0.0 AS VARCHAR), '[.]0$', '') END"


_INTERVAL_TEXT = _bound("LowerConfidence") + " || ' to ' || " + _bound("UpperConfidence")


@query("o95_interval_trends", INTERVALS + f"""
SELECT ManagedAreaName, ParameterName, ShellType, HabitatType, SizeClass, {_INTERVAL_CLASS} AS TrendStatus,
       ModelEstimate, StandardError, {_INTERVAL_TEXT} AS CredibleInterval FROM intervals""")
def interval_trends(spark, sf):
    return trends.interval_trends(X.intervals(spark, sf))


@query("o95_size_class_view", INTERVALS + f"""
SELECT ShellType AS "Shell Type", SizeClass AS "Size Class", {_INTERVAL_CLASS} AS "Trend Status",
       ModelEstimate AS Estimate, StandardError AS "Standard Error", {_INTERVAL_TEXT} AS "Credible Interval"
FROM intervals WHERE ManagedAreaName = 'NATION_7' AND ParameterName = 'Shell Height' AND SizeClass <> ''""")
def size_class_view(spark, sf):
    tables = {"Oyster Reef": trends.interval_trends(X.intervals(spark, sf))}
    return trends.trend_table(tables, "Oyster Reef", "NATION_7", "Oyster_SH")


@query("o95_density_view", INTERVALS + f"""
SELECT ShellType AS "Shell Type", HabitatType AS "Habitat Type", {_INTERVAL_CLASS} AS "Trend Status",
       ModelEstimate AS Estimate, StandardError AS "Standard Error", {_INTERVAL_TEXT} AS "Credible Interval"
FROM intervals WHERE ManagedAreaName = 'NATION_7' AND ParameterName = 'Density'""")
def density_view(spark, sf):
    return trends.interval_trend_view(trends.interval_trends(X.intervals(spark, sf)), "NATION_7", "Oyster_Dens")


@query("o52_station_trend_table", X.with_(*X.ENTITY_CTES, X.TREND_ROWS) + f""", d AS (
  SELECT Entity, ProgramLocationID, ProgramName, link, Parameter, CAST(sum(Data_N) AS BIGINT) AS Data_N,
         {X.status_sql('max(Year)')} AS Status FROM ey GROUP BY Entity, ProgramLocationID, ProgramName, link, Parameter)
SELECT d.*, t.SufficientData, t.N_Years,
  '<a href=''' || coalesce(d.link, 'NA') || ''' target=''_blank''>' || d.ProgramName || '</a>' AS ProgramNameLink,
  CASE WHEN t.SufficientData THEN '<a id=''button_' || d.Parameter || '_' || d.ProgramLocationID || ''' href=''#''>' ||
            d.Parameter || ' (' || t.N_Years || ')</a>'
       ELSE d.Parameter || ' (' || t.N_Years || ')' END AS Button,
  format('{{:,}}', d.Data_N) AS Data_N_text
FROM d JOIN trend_rows t ON d.ProgramLocationID = t.ProgramLocationID AND d.Parameter = t.ParameterName""")
def station_trend_table(spark, sf):
    return continuous.station_table(X.entity_years(spark, sf), X.trend_rows(spark, sf), X.AS_OF)


