"""Parameterised views over the summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.functions.dates import coverage_ticks
from tidewater.operators import clean, joins, rollups, segments, trends
from tidewater.sources.constants import SHORT_PROGRAMS, STATUSES

ALL = "All"


def of_habitat(habitat: str):
    """Rows of a habitat given by its display name."""
    return F.col("Habitat") == joins.threshold_habitat(F.lit(habitat))


def overview(
    entity_table: DataFrame | None, station_table: DataFrame | None, entity: str, statuses=STATUSES
) -> DataFrame:
    """Entities, or the stations of one entity with their parameter buttons.

    Only the table that the choice needs has to be given.
    """
    if entity == ALL:
        rows = clean.ordered(clean.keep(entity_table, "Status", statuses), ["-Data_N", "Entity", "link2"])
        return clean.view(
            rows,
            {
                "Entity": "Entity",
                "NumStations": "Number of Stations",
                "Data_N_text": "Number of Observations",
                "Status": "Status",
                "IncludedParams": "Parameters",
            },
        )
    rows = clean.keep(station_table.where(F.col("Entity") == entity), "Status", statuses)
    rows = rollups.collapse(
        rows, ["ProgramLocationID", "ProgramNameLink", "Status"], "Button", out="Parameters (Number of Years)"
    )
    return clean.view(
        clean.ordered(rows, ["ProgramLocationID", "ProgramNameLink", "Status"]),
        {
            "ProgramNameLink": "Program Name",
            "ProgramLocationID": "Station ID",
            "Status": "Status",
            "Parameters (Number of Years)": "Parameters (Number of Years)",
        },
    )


def station_parameters(station_table: DataFrame, entity: str, statuses=STATUSES) -> DataFrame:
    """Long form of an entity's stations and parameters."""
    rows = clean.keep(station_table.where(F.col("Entity") == entity), "Status", statuses)
    return clean.ordered(rows, ["ProgramLocationID", "Parameter"]).select(
        F.col("ProgramNameLink").alias("ProgramName"),
        "ProgramLocationID",
        F.col("Data_N_text").alias("Data_N"),
        "Status",
        "Parameter",
        "SufficientData",
    )


def coverage(
    entity_segments: DataFrame, station_segments: DataFrame, kind: str, entity: str | None = None, statuses=STATUSES
) -> DataFrame:
    """Coverage chart rows: all entities, or the stations of one entity.

    For all entities an empty status list means no filter; for one entity it
    means no rows.
    """
    if kind == ALL:
        return clean.keep(entity_segments, "Status", statuses) if statuses else entity_segments
    rows = station_segments.where(F.col("Entity") == entity)
    rows = rows.withColumn("ProgramName", X.short_names(F.col("ProgramName"), SHORT_PROGRAMS))
    return clean.keep(rows, "Status", statuses)


def coverage_axis(rows: DataFrame) -> DataFrame:
    """Year limits of a coverage chart and a tick every second year."""
    lim = rollups.extent(rows, "startYear", "endYear")
    return lim.withColumn("ticks", coverage_ticks(F.col("min_value"), F.col("max_value")))


def trend_plot(
    stats: DataFrame, monthly: DataFrame, units: DataFrame, station, parameter: str
) -> dict[str, DataFrame]:
    """Points, trendline and axes of one station and parameter.

    Where several trend rows exist the first one counts; without sufficient
    data all three are empty.
    """
    key = ["ProgramLocationID", "ParameterName"]
    chosen = (F.col("ProgramLocationID") == station) & (F.col("ParameterName") == parameter)
    row = trends.sufficient_only(segments.first_per(stats.where(chosen), key, ["MonitoringID"]))
    points = joins.known_only(trends.series(monthly, station, parameter), row.select(*key), key)
    axes = joins.lookup(trends.series_axes(points), units, ["ParameterName"], ["unit"])
    label = X.axis_label(F.col("ParameterName"), F.col("unit"))
    return {
        "points": points.orderBy("YearMonthDec"),
        "line": trends.trendline(row).orderBy("MonitoringID", "x"),
        "axes": axes.withColumn("y_label", label),
    }


def program_years(program_segments: DataFrame, habitat: str) -> DataFrame:
    """Bars of a habitat's programs, widened a little on both ends."""
    rows = program_segments.where(of_habitat(habitat))
    return rows.select(
        "ProgramID",
        (F.col("startYear") - F.lit(0.1)).alias("bar_start"),
        (F.col("endYear") + F.lit(0.1)).alias("bar_end"),
        "Status",
    )


def coverage_table(tables: dict[str, DataFrame], habitat: str, id_: str, kind: str) -> DataFrame:
    """Coverage overview of a habitat, for all or for one program or area."""
    rows = tables[f"coverage_{kind}"].where(of_habitat(habitat))
    if kind == "program":
        rows = rows if id_ == ALL else rows.where(F.col("ProgramName") == id_)
        rows = clean.ordered(rows, ["ProgramID", "ProgramName", "ParameterName", "Units"])
        return rows.drop("Habitat", "ProgramName", "pNameID")
    rows = rows.where(F.col("ManagedAreaName").isNotNull())
    rows = clean.ordered(rows, ["ManagedAreaName", "ParameterName", "Units"])
    return rows.drop("Habitat") if id_ == ALL else rows.where(F.col("ManagedAreaName") == id_).drop("Habitat", "ManagedAreaName")


def summary_table(tables: dict[str, DataFrame], habitat: str, id_: str, kind: str) -> DataFrame:
    """Value summary of a habitat, habitat-wide or for one program or area."""
    if id_ == ALL:
        return tables["summary_all"].where(of_habitat(habitat)).drop("Habitat")
    rows = tables[f"summary_{kind}"].where(of_habitat(habitat))
    if kind == "program":
        return rows.where(F.col("ProgramName") == id_).drop("Habitat", "ProgramName", "ProgramID")
    return rows.where(F.col("ManagedAreaName") == id_).drop("Habitat", "ManagedAreaName")


def area_programs(program_areas: DataFrame, habitat: str, area: str) -> DataFrame:
    """Programs of an area in a habitat."""
    return program_areas.where(of_habitat(habitat) & (F.col("ManagedAreaName") == area)).select("pNameID")


def program_area_list(program_areas: DataFrame, habitat: str, program: str) -> DataFrame:
    """Areas of a program in a habitat as one text."""
    rows = program_areas.where(of_habitat(habitat) & (F.col("ProgramName") == program))
    rows = rows.where(F.col("ManagedAreaName").isNotNull())
    return rollups.collapse(rows, ["ProgramName"], "ManagedAreaName", out="areas")


def program_link(program_areas: DataFrame, habitat: str, program: str) -> DataFrame:
    rows = program_areas.where(of_habitat(habitat) & (F.col("ProgramName") == program))
    return rows.select(X.anchor(F.col("link"), F.col("ProgramName")).alias("anchor")).distinct()


def area_link(areas: DataFrame, area: str, link_base: str) -> DataFrame:
    rows = areas.where(F.col("ManagedAreaName") == area)
    href = X.detail_link(link_base, "AreaID")
    return rows.select(X.anchor(href, F.col("ManagedAreaName")).alias("anchor"))


def station_list(station_table: DataFrame, entity: str, statuses=STATUSES) -> DataFrame:
    return station_parameters(station_table, entity, statuses).select("ProgramLocationID").distinct()


def parameter_list(station_table: DataFrame, entity: str, station, statuses=STATUSES) -> DataFrame:
    """Parameters of a station with sufficient data."""
    rows = station_parameters(station_table, entity, statuses)
    return rows.where((F.col("ProgramLocationID") == station) & F.col("SufficientData")).select("Parameter")


def status_choices(entity_table: DataFrame, station_table: DataFrame, entity: str) -> DataFrame:
    return overview(entity_table, station_table, entity).select("Status").distinct()


def region_markers(markers: DataFrame, areas: DataFrame, region: str) -> DataFrame:
    """Markers in the managed areas of a region."""
    inside = areas.where(F.col("Region") == region)
    return joins.known_only(markers, inside, ["ManagedAreaName"])


def programs_per_habitat(markers: DataFrame, habitat: str = "habitat_name") -> DataFrame:
    """Pie chart data from the location map, largest first."""
    return clean.ordered(rollups.distinct_per(markers, [habitat], "ProgramID", "numPrograms"), ["-numPrograms", habitat])


def habitat_choices(tables: dict[str, DataFrame], habitat: str, kind: str) -> DataFrame:
    """Program or area choices of a habitat."""
    if kind == "program":
        rows = tables["coverage_program"].where(of_habitat(habitat))
        return rows.select("ProgramName", "pNameID").distinct()
    return tables["summary_area"].where(of_habitat(habitat)).select("ManagedAreaName").distinct()
