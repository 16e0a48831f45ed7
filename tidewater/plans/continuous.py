"""Continuous-monitoring batch: station-year table and everything derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.functions.semantics import na_max
from tidewater.operators import clean, joins, rollups, segments
from tidewater.sources.constants import ALWAYS_LINKED, HIGHLIGHTS

KEYS = ["ProgramLocationID", "Year", "Parameter", "Region"]
ATTRS = ["ProgramID", "ProgramName", "ManagedAreaName", "Units", "Lat", "Lon"]

# Input column, name in the station-year table.
STATION_COLUMNS = {
    "ProgramLocationID": "ProgramLocationID",
    "Year": "Year",
    "ParameterName": "Parameter",
    "Region": "Region",
    "ProgramID": "ProgramID",
    "ProgramName": "ProgramName",
    "ManagedAreaName": "ManagedAreaName",
    "ParameterUnits": "Units",
    "OriginalLatitude": "Lat",
    "OriginalLongitude": "Lon",
}


def station_years(obs: DataFrame, strict: bool = False) -> DataFrame:
    """Observations per station, year, parameter and region with the station's attributes."""
    return rollups.station_year(clean.view(obs, STATION_COLUMNS), KEYS, ATTRS, strict=strict)


def entity_station_years(
    sy: DataFrame, entities: DataFrame, link_base: str, highlights=HIGHLIGHTS, always_linked=ALWAYS_LINKED
) -> DataFrame:
    return joins.attach_entity(sy, entities, highlights, link_base, always_linked)


def presence(obs: DataFrame) -> DataFrame:
    """Years in which a station reported: all that coverage segments need of the observations."""
    return obs.select("ProgramLocationID", "Year", "ProgramID", "ProgramName").distinct()


def entity_segments(df: DataFrame, as_of, mode: str = "reference") -> DataFrame:
    return segments.with_status(segments.year_segments(df, ["Entity"], mode=mode), "endYear", as_of)


def station_segments(df: DataFrame, as_of, mode: str = "reference") -> DataFrame:
    keys = ["Entity", "ProgramLocationID", "ProgramName"]
    return segments.with_status(segments.year_segments(df, keys, mode=mode), "endYear", as_of)


def station_status(df: DataFrame, as_of) -> DataFrame:
    """Last year and status per station, from station-years or presence."""
    last = df.groupBy("ProgramLocationID", "ProgramName", "Entity").agg(na_max("Year").alias("YearMax"))
    return segments.with_status(last, "YearMax", as_of)


def station_markers(df: DataFrame, as_of) -> DataFrame:
    """Map table with radius, pop-up, label and status."""
    out = segments.with_status(rollups.station_map(df), "YearMax", as_of)
    # Labels of the pop-up lines.
    popup = X.labelled(
        [
            ("<b>ProgLocID</b>", F.col("ProgramLocationID")),
            ("<b>ProgramName</b> (ID)", X.paste(F.col("ProgramName"), " (", F.col("ProgramID"), ")")),
            ("<b>Data_N</b>", X.thousands("Data_N")),
            ("<b>Years</b>", X.list_text(F.col("years"))),
            ("<b>Params</b>", X.list_text(F.col("params"))),
        ]
    )
    return out.withColumn("popup", popup).withColumn("label", F.col("ProgramLocationID").cast("string"))


def entity_table(df: DataFrame, as_of) -> DataFrame:
    """Entity overview with link and formatted count; ``Data_N`` stays numeric for sorting."""
    return rollups.entity_overview(df, as_of).select(
        "*",
        X.linked_name(F.col("link2"), F.col("Entity")).alias("EntityLink"),
        X.thousands("Data_N").alias("Data_N_text"),
    )


def station_table(df: DataFrame, stats: DataFrame, as_of) -> DataFrame:
    """Station by parameter detail with sufficiency, program link and button."""
    out = joins.attach_trend(rollups.station_detail(df, as_of), stats)
    parameter, station = F.col("Parameter"), F.col("ProgramLocationID")
    label = X.years_label(parameter, F.col("N_Years"))
    enough = F.col("SufficientData")
    clickable = X.button("button", parameter, station, label)
    return out.select(
        "*",
        X.anchor(F.col("link"), F.col("ProgramName")).alias("ProgramNameLink"),
        F.when(enough.isNull(), F.lit(None)).when(enough, clickable).otherwise(label).alias("Button"),
        X.thousands("Data_N").alias("Data_N_text"),
    )


def habitat_points(sites: DataFrame, points: DataFrame) -> DataFrame:
    """Habitat sampling sites with coordinates and pop-up."""
    out = joins.attach_points(points, sites, [("ProgramLoc", "ProgramLocationID"), "ProgramID"])
    # Labels of the pop-up lines.
    lines = X.labelled([("ProgramLocationID", F.col("ProgramLoc")), ("ProgramID", F.col("ProgramID"))])
    popup = X.paste("<br> <b>", F.col("habitat"), "</b>", lines)
    return out.select("habitat", "ProgramLoc", "ProgramID", "lat", "lon", popup.alias("popup"))


def continuous_tables(
    sy: DataFrame,
    entities: DataFrame,
    stats: DataFrame,
    as_of,
    link_base: str,
    overrides: DataFrame | None = None,
    highlights=HIGHLIGHTS,
) -> dict[str, DataFrame]:
    """All summary tables from a (preferably materialised) station-year table.

    ``overrides`` holds ``ProgramLocationID``, ``endYear`` and ``Status`` of
    stations to pin.
    """
    df = entity_station_years(sy, entities, link_base, highlights)
    by_station = station_segments(df, as_of)
    detail = station_table(df, stats, as_of)
    if overrides is not None:
        on = ["ProgramLocationID"]
        by_station = clean.apply_overrides(by_station, overrides.select(*on, "endYear", "Status"), on)
        detail = clean.apply_overrides(detail, overrides.select(*on, "Status"), on)
    return {
        "entity_segments": entity_segments(df, as_of),
        "station_segments": by_station,
        "station_markers": station_markers(df, as_of),
        "entity_table": entity_table(df, as_of),
        "station_table": detail,
    }
