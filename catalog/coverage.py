"""Coverage segments and status."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog import query
from tidewater.operators import segments
from tidewater.plans import continuous, habitat

OBS = X.with_(X.OBS)
KEYS = ["LocationID", "ActivityType"]


@query("o40_year_segments", X.with_(X.OBS, X.segment_ctes("seg", "obs", "LocationID, ActivityType"))
       + "SELECT * FROM seg")
def year_segments(spark, sf):
    return segments.year_segments(X.obs(spark, sf), KEYS)


@query("o41_year_islands", OBS + """
SELECT LocationID, ActivityType, min(y) AS startYear, max(y) AS endYear
FROM (SELECT *, y - row_number() OVER (PARTITION BY LocationID, ActivityType ORDER BY y) AS run
      FROM (SELECT DISTINCT LocationID, ActivityType, Year AS y FROM obs))
GROUP BY LocationID, ActivityType, run""")
def year_islands(spark, sf):
    return segments.year_segments(X.obs(spark, sf), KEYS, mode="islands")


@query("o42_entity_segments", X.with_(*X.ENTITY_CTES, X.segment_ctes("seg", "ey", "Entity"))
       + f"SELECT *, {X.status_sql('endYear')} AS Status FROM seg")
def entity_segments(spark, sf):
    return continuous.entity_segments(X.entity_presence(spark, sf), X.AS_OF)


_STATION = X.with_(*X.ENTITY_CTES, X.segment_ctes("seg", "ey", "Entity, ProgramLocationID, ProgramName"))


@query("o43_station_segments", _STATION + f"SELECT *, {X.status_sql('endYear')} AS Status FROM seg")
def station_segments(spark, sf):
    from tidewater.operators.clean import ordered

    return ordered(
        continuous.station_segments(X.entity_presence(spark, sf), X.AS_OF),
        ["ProgramName", "ProgramLocationID", "startYear"],
    )


@query("o44_program_segments", X.with_(*X.HABITAT_CTES, X.segment_ctes("seg", "hab", "Habitat, ProgramID")) + f"""
SELECT Habitat, ProgramID, startYear, endYear,
       {X.status_sql('max(endYear) OVER (PARTITION BY Habitat, ProgramID)')} AS Status FROM seg""")
def program_segments(spark, sf):
    return habitat.program_segments(X.habitat_cells(spark, sf), X.AS_OF)


_SEG = X.with_(X.OBS, X.segment_ctes("seg", "obs", "LocationID, ActivityType"))


@query("o45_segment_status", _SEG + f"SELECT *, {X.status_sql('endYear')} AS Status FROM seg")
def segment_status(spark, sf):
    return segments.with_status(segments.year_segments(X.obs(spark, sf), KEYS), "endYear", X.AS_OF)


@query("o46_group_status", _SEG + f"""
SELECT *, {X.status_sql('max(endYear) OVER (PARTITION BY LocationID, ActivityType)')} AS Status FROM seg""")
def group_status(spark, sf):
    return segments.with_status(segments.year_segments(X.obs(spark, sf), KEYS), "endYear", X.AS_OF, per=KEYS)


@query("o47_station_status", X.with_(*X.ENTITY_CTES) + f"""
SELECT ProgramLocationID, ProgramName, Entity, max(Year) AS YearMax, {X.status_sql('max(Year)')} AS Status
FROM ey GROUP BY ALL""")
def station_status(spark, sf):
    return continuous.station_status(X.entity_presence(spark, sf), X.AS_OF)


@query("o48_parameter_status", OBS + f"""
SELECT LocationID, ParameterName, ActivityType, {X.status_sql('max(Year)')} AS Status, count(*) AS n FROM obs GROUP BY ALL""")
def parameter_status(spark, sf):
    from tidewater.functions.dates import status_of
    from tidewater.functions.semantics import na_max

    return X.obs(spark, sf).groupBy("LocationID", "ParameterName", "ActivityType").agg(
        status_of(na_max("Year"), X.AS_OF).alias("Status"), F.count(F.lit(1)).alias("n")
    )


@query("o49_first_trend_row", X.with_(X.TREND_ROWS) + """
SELECT ProgramLocationID, ParameterName, MonitoringID, EarliestSampleDate, N_Years
FROM (SELECT *, row_number() OVER (PARTITION BY ProgramLocationID, ParameterName
                                   ORDER BY EarliestSampleDate, MonitoringID) AS k FROM trend_rows) WHERE k = 1""")
def first_trend_row(spark, sf):
    out = segments.first_per(
        X.trend_rows(spark, sf), ["ProgramLocationID", "ParameterName"], ["EarliestSampleDate", "MonitoringID"]
    )
    return out.select("ProgramLocationID", "ParameterName", "MonitoringID", "EarliestSampleDate", "N_Years")


@query("o50_year_gaps", OBS + """
SELECT *, lead(Year) OVER (PARTITION BY LocationID, ActivityType ORDER BY Year) - Year AS gap
FROM (SELECT DISTINCT LocationID, ActivityType, Year FROM obs)""")
def year_gaps(spark, sf):
    return segments.year_gaps(X.obs(spark, sf), KEYS)
