"""Counts, summaries, coverage overviews and distinct lists."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog import query
from tidewater.functions.text import list_text, thousands
from tidewater.operators import rollups
from tidewater.plans import continuous, habitat

OBS = X.with_(X.OBS)
ENTITY = X.with_(*X.ENTITY_CTES)
HAB = X.with_(*X.HABITAT_CTES)


@query("o21_station_year", OBS + """
SELECT LocationID, Year, ProgramID, Region, CAST(sum(n) OVER (PARTITION BY LocationID, Year) AS BIGINT) AS Data_N
FROM (SELECT LocationID, Year, ProgramID, Region, count(*) AS n FROM obs GROUP BY ALL)""")
def station_year(spark, sf):
    return rollups.station_year(X.obs(spark, sf), ["LocationID", "Year"], ["ProgramID", "Region"])


@query("o22_two_level_count", X.with_(X.OBS, X.SY) + """
SELECT ProgramLocationID, Parameter, CAST(sum(Data_N) AS BIGINT) AS Data_N FROM sy GROUP BY ALL""")
def two_level_count(spark, sf):
    return X.station_years(spark, sf).groupBy("ProgramLocationID", "Parameter").agg(F.sum("Data_N").alias("Data_N"))


@query("o23_site_counts", OBS + """
SELECT Habitat, ProgramID, ProgramLocationID, count(*) AS N_Data FROM obs GROUP BY ALL""")
def site_counts(spark, sf):
    return rollups.site_counts(X.obs(spark, sf), ["Habitat", "ProgramID", "ProgramLocationID"])


@query("o24_station_map", ENTITY + """, s AS (
  SELECT ProgramLocationID, ProgramID, ProgramName, Entity,
         array_to_string(list_sort(list(DISTINCT Year)), ', ') AS years,
         array_to_string(list_sort(list(DISTINCT Parameter)), ', ') AS params,
         min(Year) AS YearMin, max(Year) AS YearMax, CAST(sum(Data_N) AS BIGINT) AS Data_N
  FROM ey GROUP BY ALL),
q AS (SELECT DISTINCT ProgramLocationID, ProgramID, ProgramName, Entity, round(Lat, 5) AS Lat, round(Lon, 5) AS Lon, Region FROM ey)
SELECT s.*, q.Lat, q.Lon, q.Region, round(sqrt(Data_N) / 100, 6) AS rad
FROM s JOIN q USING (ProgramLocationID, ProgramID, ProgramName, Entity)""")
def station_map(spark, sf):
    out = rollups.station_map(X.entity_years(spark, sf))
    return out.withColumns({
        "years": list_text(F.col("years")), "params": list_text(F.col("params")),
        "Lat": F.round("Lat", 5), "Lon": F.round("Lon", 5), "rad": F.round("rad", 6),
    })


@query("o25_entity_overview", ENTITY + f"""
SELECT Entity, link2, {X.status_sql('max(Year)')} AS Status, count(DISTINCT ProgramLocationID) AS NumStations,
       CAST(sum(Data_N) AS BIGINT) AS Data_N, string_agg(DISTINCT Parameter, ', ' ORDER BY Parameter) AS IncludedParams,
       CASE WHEN link2 IS NOT NULL THEN '<a href=''' || link2 || ''' target=''_blank''>' || Entity || '</a>' ELSE Entity END AS EntityLink,
       format('{{:,}}', CAST(sum(Data_N) AS BIGINT)) AS Data_N_text
FROM ey GROUP BY Entity, link2""")
def entity_overview(spark, sf):
    from tidewater.operators.clean import ordered

    return ordered(continuous.entity_table(X.entity_years(spark, sf), X.AS_OF), ["-Data_N", "Entity", "link2"])


@query("o26_station_detail", ENTITY + f"""
SELECT Entity, ProgramLocationID, ProgramName, link, Parameter, CAST(sum(Data_N) AS BIGINT) AS Data_N,
       {X.status_sql('max(Year)')} AS Status
FROM ey GROUP BY Entity, ProgramLocationID, ProgramName, link, Parameter""")
def station_detail(spark, sf):
    from tidewater.operators.clean import ordered

    return ordered(rollups.station_detail(X.entity_years(spark, sf), X.AS_OF), ["-ProgramName", "-Data_N", "ProgramLocationID", "Parameter"])


@query("o27_programs_per_parameter", HAB + """
SELECT Habitat, ParameterName, count(DISTINCT ProgramID) AS n FROM hab GROUP BY ALL""")
def programs_per_parameter(spark, sf):
    return rollups.distinct_per(X.habitat_cells(spark, sf), ["Habitat", "ParameterName"], "ProgramID")


@query("o27_areas_per_parameter_with_missing", OBS + """
SELECT ParameterName, count(DISTINCT coalesce(ManagedAreaName, '-')) AS n FROM obs GROUP BY ALL""")
def areas_per_parameter(spark, sf):
    return rollups.distinct_per(X.obs(spark, sf), ["ParameterName"], "ManagedAreaName")


@query("o28_programs_per_habitat", X.with_(*X.HABITAT_CTES, X.LOCATION_POINTS) + f"""
SELECT habitat_name, count(DISTINCT ProgramID) AS numPrograms FROM (
  SELECT {X.HABITAT_NAME} AS habitat_name, h.ProgramID FROM hab h JOIN location_points p
    ON h.ProgramLocationID = p.ProgramLoc AND h.ProgramID = p.ProgramID AND h.LocationID = p.LocationID)
GROUP BY habitat_name""")
def programs_per_habitat(spark, sf):
    from tidewater.plans.views import programs_per_habitat as view

    return view(habitat.location_map(X.habitat_cells(spark, sf), X.location_points(spark, sf), "n_rows"))


@query("o29_program_areas", HAB + f"""
SELECT DISTINCT Habitat, ProgramID, ProgramName, ManagedAreaName, ProgramID || ' - ' || ProgramName AS pNameID,
       '{X.LINK}' || ProgramID AS link FROM hab""")
def program_areas(spark, sf):
    return rollups.program_areas(X.habitat_cells(spark, sf), X.LINK)


@query("o30_location_markers", HAB + """
SELECT Habitat, ProgramLocationID, ProgramID, ProgramName, LocationID, count(*) AS n_data,
       array_to_string(list_sort(list(DISTINCT Year)), ', ') AS years,
       array_to_string(list_sort(list(DISTINCT ParameterName)), ', ') AS params
FROM hab GROUP BY ALL""")
def location_markers(spark, sf):
    out = rollups.location_markers(X.habitat_cells(spark, sf), n="n_rows")
    return out.withColumns({"years": list_text(F.col("years")), "params": list_text(F.col("params"))})


_VALUES = f"count(*) AS N_samples, {X.r_round('avg(ResultValue)', 2)} AS mean, min(ResultValue) AS min, max(ResultValue) AS max"


@query("o31_value_summary", HAB + f"SELECT Habitat, ParameterName, Units, {_VALUES} FROM hab GROUP BY ALL")
def value_summary(spark, sf):
    return habitat.summary(X.habitat_cells(spark, sf), cells=True)


@query("o31_summaries_of_all_grains", HAB + f"""
SELECT 'all' AS grain, Habitat, ParameterName, Units, NULL::INTEGER AS ProgramID, NULL::VARCHAR AS ProgramName,
       NULL::VARCHAR AS ManagedAreaName, {_VALUES} FROM hab GROUP BY ALL
UNION ALL
SELECT 'program', Habitat, ParameterName, Units, ProgramID, ProgramName, NULL, {_VALUES} FROM hab GROUP BY ALL
UNION ALL
SELECT 'area', Habitat, ParameterName, Units, NULL, NULL, ManagedAreaName, {_VALUES} FROM hab
WHERE ManagedAreaName IS NOT NULL GROUP BY ALL""")
def summaries_of_all_grains(spark, sf):
    return habitat.summaries(X.habitat_cells(spark, sf))


@query("o31_value_summary_with_missing", OBS + f"""
SELECT ParameterName, ProgramID, Year, count(*) AS N_samples,
       CASE WHEN count(SparseValue) = count(*) THEN {X.r_round('avg(SparseValue)', 6)} END AS mean,
       CASE WHEN count(SparseValue) = count(*) THEN min(SparseValue) END AS min,
       CASE WHEN count(SparseValue) = count(*) THEN max(SparseValue) END AS max
FROM obs GROUP BY ALL""")
def value_summary_with_missing(spark, sf):
    return rollups.value_summary(X.obs(spark, sf), ["ParameterName", "ProgramID", "Year"], "SparseValue", 6)


@query("o32_value_summary_by_program", HAB + f"""
SELECT Habitat, ParameterName, Units, ProgramID, ProgramName, {_VALUES} FROM hab GROUP BY ALL""")
def value_summary_by_program(spark, sf):
    from tidewater.operators.clean import ordered

    return ordered(habitat.summary(X.habitat_cells(spark, sf), "program", cells=True), ["ProgramID", "ParameterName", "Units"])


@query("o33_value_summary_by_area", HAB + f"""
SELECT Habitat, ParameterName, Units, ManagedAreaName, {_VALUES} FROM hab WHERE ManagedAreaName IS NOT NULL GROUP BY ALL""")
def value_summary_by_area(spark, sf):
    return habitat.summary(X.habitat_input(spark, sf), "area")


@query("o33_area_summary_from_cells", HAB + f"""
SELECT Habitat, ParameterName, Units, ManagedAreaName, {_VALUES} FROM hab WHERE ManagedAreaName IS NOT NULL GROUP BY ALL""")
def area_summary_from_cells(spark, sf):
    return habitat.summary(X.habitat_cells(spark, sf), "area", cells=True)


_COVER = """count(DISTINCT ProgramLocationID) AS "Number of Stations", count(*) AS "Number of Observations",
       count(DISTINCT Year) AS "Years of Data", min(Year) || ' - ' || max(Year) AS "Period of Record\""""


@query("o34_coverage_by_program", HAB + f"""
SELECT Habitat, ProgramName, ProgramID, ParameterName, Units, {_COVER}, ProgramID || ' - ' || ProgramName AS pNameID
FROM hab GROUP BY Habitat, ProgramName, ProgramID, ParameterName, Units""")
def coverage_by_program(spark, sf):
    return habitat.coverage(X.habitat_cells(spark, sf), "program", "n_rows")


@query("o35_coverage_by_area", HAB + f"""
SELECT Habitat, ManagedAreaName, ParameterName, Units, {_COVER} FROM hab GROUP BY Habitat, ManagedAreaName, ParameterName, Units""")
def coverage_by_area(spark, sf):
    return habitat.coverage(X.habitat_cells(spark, sf), "area", "n_rows")


@query("o36_distinct_lists", OBS + """
SELECT 'area' AS list, ManagedAreaName AS value FROM obs GROUP BY ALL
UNION ALL SELECT 'parameter', ParameterName FROM obs GROUP BY ALL
UNION ALL SELECT 'program', ProgramName FROM obs GROUP BY ALL
UNION ALL SELECT 'station', CAST(ProgramLocationID AS VARCHAR) FROM obs GROUP BY ALL""")
def distinct_lists(spark, sf):
    lists = F.array(*[
        F.struct(F.lit(name).alias("list"), F.col(col).cast("string").alias("value"))
        for name, col in [
            ("area", "ManagedAreaName"), ("parameter", "ParameterName"),
            ("program", "ProgramName"), ("station", "ProgramLocationID"),
        ]
    ])
    return rollups.distinct_values(X.obs(spark, sf).select(F.inline(lists)), "list", "value")


@query("o37_distinct_points", OBS + """
SELECT DISTINCT ProgramLocationID, round(OriginalLatitude, 5) AS lat, round(OriginalLongitude, 5) AS lon, Habitat AS habitat FROM obs""")
def distinct_points(spark, sf):
    rows = X.obs(spark, sf).select(
        "ProgramLocationID", F.round("OriginalLatitude", 5).alias("lat"),
        F.round("OriginalLongitude", 5).alias("lon"), F.col("Habitat").alias("habitat"),
    )
    return rollups.distinct_points(rows)


@query("o38_parameters_per_station", OBS + """
SELECT ProgramLocationID, string_agg(DISTINCT ParameterName, ', ' ORDER BY ParameterName) AS parameters FROM obs GROUP BY ALL""")
def parameters_per_station(spark, sf):
    return rollups.collapse(X.obs(spark, sf), ["ProgramLocationID"], "ParameterName", out="parameters")


@query("o38_areas_per_program", OBS + """
SELECT ParameterName, array_to_string(list_sort(list(DISTINCT ManagedAreaName)), ', ') AS areas FROM obs GROUP BY ALL""")
def areas_per_program(spark, sf):
    return rollups.collapse(X.obs(spark, sf), ["ParameterName"], "ManagedAreaName", out="areas")


@query("o39_extent", OBS + "SELECT min(Year) AS min_value, max(Year) AS max_value FROM obs")
def extent(spark, sf):
    return rollups.extent(X.obs(spark, sf), "Year", "Year")


@query("o75_counts_as_text", OBS + """
SELECT ProgramID, Year, format('{:,}', count(*)) AS n_text, count(*) AS n FROM obs GROUP BY ALL""")
def counts_as_text(spark, sf):
    out = X.obs(spark, sf).groupBy("ProgramID", "Year").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("n_text", thousands("n"))


@query("o107_all_points", OBS + """
SELECT Habitat, ProgramID, ProgramName, ProgramLocationID, Region, round(OriginalLatitude, 5) AS lat,
       round(OriginalLongitude, 5) AS lon, count(*) AS n,
       coalesce(string_agg(DISTINCT ManagedAreaName, ', ' ORDER BY ManagedAreaName), 'NA') AS areas
FROM obs WHERE OriginalLatitude IS NOT NULL AND OriginalLongitude IS NOT NULL
GROUP BY Habitat, ProgramID, ProgramName, ProgramLocationID, Region, lat, lon""")
def all_points(spark, sf):
    rows = X.obs(spark, sf).withColumns({
        "lat": F.round("OriginalLatitude", 5), "lon": F.round("OriginalLongitude", 5),
    })
    return rollups.all_points(rows).withColumn("areas", list_text(F.col("areas")))
