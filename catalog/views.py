"""Parameterised views with fixed arguments.

A view of one entity, program, area or station is the feature here; each table
it filters is computed from the whole input.
"""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog import query
from tidewater.operators import rollups
from tidewater.plans import continuous, habitat, views
from tidewater.sources.dimensions import columns, dimension

HAB = X.with_(*X.HABITAT_CTES)
ENTITY = X.with_(*X.ENTITY_CTES)
_STATION = X.with_(*X.ENTITY_CTES, X.TREND_ROWS) + f""", d AS (
  SELECT Entity, ProgramLocationID, ProgramName, link, Parameter, CAST(sum(Data_N) AS BIGINT) AS Data_N,
         {X.status_sql('max(Year)')} AS Status FROM ey GROUP BY Entity, ProgramLocationID, ProgramName, link, Parameter),
st AS (
  SELECT d.*, t.SufficientData, t.N_Years,
    '<a href=''' || coalesce(d.link, 'NA') || ''' target=''_blank''>' || d.ProgramName || '</a>' AS ProgramNameLink,
    CASE WHEN t.SufficientData THEN '<a id=''button_' || d.Parameter || '_' || d.ProgramLocationID || ''' href=''#''>' ||
              d.Parameter || ' (' || t.N_Years || ')</a>' ELSE d.Parameter || ' (' || t.N_Years || ')' END AS Button
  FROM d JOIN trend_rows t ON d.ProgramLocationID = t.ProgramLocationID AND d.Parameter = t.ParameterName)
"""


def station_table(spark, sf):
    return continuous.station_table(X.entity_years(spark, sf), X.trend_rows(spark, sf), X.AS_OF)


def entity_table(spark, sf):
    return continuous.entity_table(X.entity_years(spark, sf), X.AS_OF)


@query("o96_overview_all", ENTITY + f"""
SELECT Entity, count(DISTINCT ProgramLocationID) AS "Number of Stations", format('{{:,}}', CAST(sum(Data_N) AS BIGINT)) AS "Number of Observations",
       {X.status_sql('max(Year)')} AS Status, string_agg(DISTINCT Parameter, ', ' ORDER BY Parameter) AS Parameters
FROM ey GROUP BY Entity, link2 HAVING max(Year) >= 2001""")
def overview_all(spark, sf):
    return views.overview(entity_table(spark, sf), None, "All", ["Active"])


@query("o96_overview_entity", _STATION + """
SELECT ProgramNameLink AS "Program Name", ProgramLocationID AS "Station ID", Status,
       string_agg(DISTINCT Button, ', ' ORDER BY Button) AS "Parameters (Number of Years)"
FROM st WHERE Entity = 'GROUP_AFRICA' AND Status IN ('Active', 'Historical') GROUP BY ALL""")
def overview_entity(spark, sf):
    return views.overview(None, station_table(spark, sf), "GROUP_AFRICA")


@query("o97_station_parameters", _STATION + """
SELECT ProgramNameLink AS ProgramName, ProgramLocationID, format('{:,}', Data_N) AS Data_N, Status, Parameter, SufficientData
FROM st WHERE Entity = 'GROUP_ASIA' AND Status = 'Active'""")
def station_parameters(spark, sf):
    return views.station_parameters(station_table(spark, sf), "GROUP_ASIA", ["Active"])


def _segments(spark, sf):
    df = X.entity_presence(spark, sf)
    return continuous.entity_segments(df, X.AS_OF), continuous.station_segments(df, X.AS_OF)


_ENTITY_SEG = X.with_(*X.ENTITY_CTES, X.segment_ctes("seg", "ey", "Entity"))
_STATION_SEG = X.with_(*X.ENTITY_CTES, X.segment_ctes("seg", "ey", "Entity, ProgramLocationID, ProgramName"))


@query("o98_coverage_all", _ENTITY_SEG + f"SELECT *, {X.status_sql('endYear')} AS Status FROM seg")
def coverage_all(spark, sf):
    return views.coverage(*_segments(spark, sf), "All", statuses=[])


@query("o98_coverage_entity", _STATION_SEG + f"""
SELECT *, {X.status_sql('endYear')} AS Status FROM seg WHERE Entity = 'GROUP_AMERICA' AND endYear >= 2001""")
def coverage_entity(spark, sf):
    return views.coverage(*_segments(spark, sf), "Entity", "GROUP_AMERICA", ["Active"])


@query("o98_coverage_axis", _STATION_SEG + """
SELECT min(startYear) AS min_value, max(endYear) AS max_value,
       array_to_string(range(max(endYear), min(startYear) - 1, -2), ', ') AS ticks
FROM seg WHERE Entity = 'GROUP_AMERICA'""")
def coverage_axis(spark, sf):
    out = views.coverage_axis(views.coverage(*_segments(spark, sf), "Entity", "GROUP_AMERICA"))
    return out.withColumn("ticks", F.concat_ws(", ", F.col("ticks").cast("array<string>")))


_PLOT = X.with_(X.TREND_ROWS, X.MONTHLY) + """, one AS (
  SELECT * FROM trend_rows WHERE ProgramLocationID = 3 AND ParameterName = 'MEDIUM' ORDER BY MonitoringID LIMIT 1),
pts AS (SELECT * FROM monthly SEMI JOIN (SELECT * FROM one WHERE SufficientData) USING (ProgramLocationID, ParameterName))
"""


def _trend_plot(spark, sf):
    units = dimension(spark, [("MEDIUM", "mg/L")], columns("ParameterName", "unit"))
    return views.trend_plot(X.trend_rows(spark, sf), X.monthly(spark, sf), units, 3, "MEDIUM")


@query("o93_trend_plot_points", _PLOT + "SELECT Year, round(YearMonthDec, 6) AS x, round(Mean, 6) AS y FROM pts")
def trend_plot_points(spark, sf):
    out = _trend_plot(spark, sf)["points"]
    return out.select("Year", F.round("YearMonthDec", 6).alias("x"), F.round("Mean", 6).alias("y"))


@query("o92_trend_plot_line", _PLOT + """
SELECT MonitoringID, round((x - EarliestYear) * SennSlope + SennIntercept, 6) AS y
FROM (SELECT *, year(d) + (dayofyear(d) - 1) / dayofyear(make_date(year(d), 12, 31))::DOUBLE AS x
      FROM (SELECT *, unnest([EarliestSampleDate, LastSampleDate]) AS d FROM one WHERE SufficientData))
WHERE SennSlope IS NOT NULL""")
def trend_plot_line(spark, sf):
    return _trend_plot(spark, sf)["line"].select("MonitoringID", F.round("y", 6).alias("y"))


@query("o86_trend_plot_axes", _PLOT + """
SELECT ParameterName || ' (mg/L)' AS y_label, min(Year) AS t_min, round(min(Mean), 6) AS min_mean FROM pts GROUP BY ParameterName""")
def trend_plot_axes(spark, sf):
    return _trend_plot(spark, sf)["axes"].select("y_label", "t_min", F.round("min_mean", 6).alias("min_mean"))


@query("o99_program_years", X.with_(*X.HABITAT_CTES, X.segment_ctes("seg", "hab", "Habitat, ProgramID")) + f"""
SELECT ProgramID, round(startYear - 0.1::DOUBLE, 4) AS bar_start, round(endYear + 0.1::DOUBLE, 4) AS bar_end,
       {X.status_sql('max(endYear) OVER (PARTITION BY Habitat, ProgramID)')} AS Status FROM seg WHERE Habitat = 'Oyster/Oyster Reef'""")
def program_years(spark, sf):
    out = views.program_years(habitat.program_segments(X.habitat_cells(spark, sf), X.AS_OF), "Oyster Reef")
    return out.withColumns({"bar_start": F.round("bar_start", 4), "bar_end": F.round("bar_end", 4)})


def _one(spark, sf, make, kind):
    """Just the table that a view reads."""
    cells = X.habitat_cells(spark, sf)
    table = make(cells, kind, "n_rows") if make is habitat.coverage else make(cells, kind, cells=True)
    return {f"{make.__name__}_{kind}": table}


def _areas(spark, sf):
    return rollups.program_areas(X.habitat_cells(spark, sf), X.LINK)


_COVER = """count(DISTINCT ProgramLocationID) AS "Number of Stations", count(*) AS "Number of Observations",
       count(DISTINCT Year) AS "Years of Data", min(Year) || ' - ' || max(Year) AS "Period of Record\""""
_VALUES = f"count(*) AS N_samples, {X.r_round('avg(ResultValue)', 2)} AS mean, min(ResultValue) AS min, max(ResultValue) AS max"


@query("o100_coverage_of_program", HAB + f"""
SELECT ProgramID, ParameterName, Units, {_COVER} FROM hab WHERE Habitat = 'Oyster/Oyster Reef' AND ProgramName = 'NATION_8' GROUP BY ProgramID, ParameterName, Units""")
def coverage_of_program(spark, sf):
    return views.coverage_table(_one(spark, sf, habitat.coverage, "program"), "Oyster Reef", "NATION_8", "program")


@query("o100_coverage_of_areas", HAB + f"""
SELECT ManagedAreaName, ParameterName, Units, {_COVER} FROM hab WHERE Habitat = 'Oyster/Oyster Reef' AND ManagedAreaName IS NOT NULL
GROUP BY ManagedAreaName, ParameterName, Units""")
def coverage_of_areas(spark, sf):
    return views.coverage_table(_one(spark, sf, habitat.coverage, "area"), "Oyster Reef", "All", "area")


@query("o101_summary_of_habitat", HAB + f"SELECT ParameterName, Units, {_VALUES} FROM hab WHERE Habitat = 'Oyster/Oyster Reef' GROUP BY ParameterName, Units")
def summary_of_habitat(spark, sf):
    return views.summary_table(_one(spark, sf, habitat.summary, "all"), "Oyster Reef", "All", "program")


@query("o101_summary_of_area", HAB + f"""
SELECT ParameterName, Units, {_VALUES} FROM hab WHERE Habitat = 'Oyster/Oyster Reef' AND ManagedAreaName = 'EUROPE' GROUP BY ParameterName, Units""")
def summary_of_area(spark, sf):
    return views.summary_table(_one(spark, sf, habitat.summary, "area"), "Oyster Reef", "EUROPE", "area")


@query("o101_summary_of_program", HAB + f"""
SELECT ParameterName, Units, {_VALUES} FROM hab WHERE Habitat = 'Oyster/Oyster Reef' AND ProgramName = 'NATION_8' GROUP BY ParameterName, Units""")
def summary_of_program(spark, sf):
    return views.summary_table(_one(spark, sf, habitat.summary, "program"), "Oyster Reef", "NATION_8", "program")


@query("o102_area_programs", HAB + """
SELECT DISTINCT ProgramID || ' - ' || ProgramName AS pNameID FROM hab WHERE Habitat = 'Oyster/Oyster Reef' AND ManagedAreaName = 'AFRICA'""")
def area_programs(spark, sf):
    return views.area_programs(_areas(spark, sf), "Oyster Reef", "AFRICA")


@query("o102_program_area_list", HAB + """
SELECT ProgramName, string_agg(DISTINCT ManagedAreaName, ', ' ORDER BY ManagedAreaName) AS areas
FROM hab WHERE Habitat = 'Oyster/Oyster Reef' AND ProgramName = 'NATION_8' AND ManagedAreaName IS NOT NULL GROUP BY ProgramName""")
def program_area_list(spark, sf):
    return views.program_area_list(_areas(spark, sf), "Oyster Reef", "NATION_8")


@query("o102_program_link", HAB + f"""
SELECT DISTINCT '<a href=''{X.LINK}' || ProgramID || ''' target=''_blank''>' || ProgramName || '</a>' AS anchor
FROM hab WHERE Habitat = 'Oyster/Oyster Reef' AND ProgramName = 'NATION_8'""")
def program_link(spark, sf):
    return views.program_link(_areas(spark, sf), "Oyster Reef", "NATION_8")


@query("o102_area_link", f"""
SELECT '<a href=''{X.LINK}' || r_regionkey || ''' target=''_blank''>' || r_name || '</a>' AS anchor FROM region WHERE r_name = 'ASIA'""")
def area_link(spark, sf):
    areas = X.table(spark, sf, "region").select(
        F.col("r_regionkey").alias("AreaID"), F.col("r_name").alias("ManagedAreaName")
    )
    return views.area_link(areas, "ASIA", X.LINK)


@query("o104_station_list", _STATION + "SELECT DISTINCT ProgramLocationID FROM st WHERE Entity = 'GROUP_AMERICA' AND Status IS NOT NULL")
def station_list(spark, sf):
    return views.station_list(station_table(spark, sf), "GROUP_AMERICA")


@query("o104_parameter_list", _STATION + """
SELECT Parameter FROM st WHERE Entity = 'GROUP_AFRICA' AND ProgramLocationID = 0 AND SufficientData AND Status IS NOT NULL""")
def parameter_list(spark, sf):
    return views.parameter_list(station_table(spark, sf), "GROUP_AFRICA", 0)


@query("o104_status_choices", ENTITY + f"""
SELECT DISTINCT {X.status_sql('max(Year)')} AS Status FROM ey GROUP BY Entity, link2""")
def status_choices(spark, sf):
    return views.status_choices(entity_table(spark, sf), None, "All")


@query("o104_habitat_choices", HAB + "SELECT DISTINCT ProgramName, ProgramID || ' - ' || ProgramName AS pNameID FROM hab WHERE Habitat = 'Oyster/Oyster Reef'")
def habitat_choices(spark, sf):
    return views.habitat_choices(_one(spark, sf, habitat.coverage, "program"), "Oyster Reef", "program")
