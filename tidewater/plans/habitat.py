"""Habitat batch: one gated, unit-enriched input and the tables derived from it.

The habitat is a column and part of every key, so each table of all habitats is
one aggregation instead of one per habitat.  A batch run reduces the gated input
to cells in one scan and joins the units to the cells, whose keys hold all that
the units depend on; the tables then read the cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.operators import clean, joins, rollups, segments
from tidewater.sources.constants import EXCLUDED_PARAMETERS

HABITAT = "Habitat"
CELL_KEYS = [
    HABITAT, "ParameterName", "ProgramID", "ProgramName", "ProgramLocationID", "LocationID",
    "ManagedAreaName", "Year",
]


def gated(obs: DataFrame, flags: dict[str, object] | None = None, excluded=EXCLUDED_PARAMETERS) -> DataFrame:
    """Quality gate and excluded parameters."""
    return clean.exclude(clean.quality_gate(obs, flags), "ParameterName", excluded)


def habitat_input(
    obs: DataFrame,
    thresholds: DataFrame,
    flags: dict[str, object] | None = None,
    excluded=EXCLUDED_PARAMETERS,
) -> DataFrame:
    """Gated observations with units, row by row; tables are better made from ``habitat_cells``."""
    return joins.attach_units(gated(obs, flags, excluded), thresholds)


def program_segments(df: DataFrame, as_of, mode: str = "reference") -> DataFrame:
    """Segments per program; the status is that of the program's latest segment."""
    keys = [HABITAT, "ProgramID"]
    return segments.with_status(segments.year_segments(df, keys, mode=mode), "endYear", as_of, per=keys)


def habitat_cells(
    obs: DataFrame,
    thresholds: DataFrame,
    flags: dict[str, object] | None = None,
    excluded=EXCLUDED_PARAMETERS,
) -> DataFrame:
    """The gated input reduced once to the finest grain of the tables below, then its units.

    A duplicated threshold multiplies cells as it would multiply their rows.
    """
    return joins.attach_units(rollups.value_cells(gated(obs, flags, excluded), CELL_KEYS), thresholds)


def location_map(df: DataFrame, points: DataFrame, n: str | None = None) -> DataFrame:
    """Sampling locations of each habitat that have a point, with pop-up, label, radius and the
    habitat's display name as ``habitat_name``."""
    keys = ["ProgramLocationID", "ProgramID", "LocationID"]
    marks = rollups.location_markers(df, n=n)
    out = joins.attach_points(marks, points, [("ProgramLocationID", "ProgramLoc"), *keys[1:]])
    # Labels of the pop-up lines.
    lines = [
        ("ProgramID: ", F.col("ProgramID")),
        ("<br> ProgramName: ", F.col("ProgramName")),
        ("<br> LocID: ", F.col("LocationID")),
        ("<br> ProgLocID: ", F.col("ProgramLocationID")),
        ("<br> N_Data: ", F.col("n_data")),
        ("<br> Years: ", X.list_text(F.col("years"))),
        ("<br> params: ", X.list_text(F.col("params"))),
    ]
    parts = [p for i, (name, value) in enumerate(lines) for p in (" " * (i > 0) + name + " ", value)]
    label = X.paste(F.col("ProgramID"), ": ", F.col("ProgramName"), " - LocID: ", F.col("LocationID"))
    return out.withColumns(
        {
            "popup": X.paste(*parts),
            "label": label,
            "rad": rollups.bubble(F.col("n_data"), 8),
            "habitat_name": joins.habitat_name(F.col(HABITAT)),
        }
    )


def coverage(df: DataFrame, kind: str, n: str | None = None) -> DataFrame:
    """Coverage overview per program or per managed area (a missing area is a group)."""
    if kind == "program":
        keys = [HABITAT, "ProgramName", "ProgramID", "ParameterName", "Units"]
        return rollups.coverage_overview(df, keys, n=n).withColumn("pNameID", X.id_name("ProgramID", "ProgramName"))
    return rollups.coverage_overview(df, [HABITAT, "ManagedAreaName", "ParameterName", "Units"], n=n)


def summary(df: DataFrame, kind: str = "all", cells: bool = False) -> DataFrame:
    """Value summary of the habitat, per program, or per known managed area."""
    keys = [HABITAT, "ParameterName", "Units"]
    if kind == "program":
        keys += ["ProgramID", "ProgramName"]
    elif kind == "area":
        df = df.where(F.col("ManagedAreaName").isNotNull())
        keys += ["ManagedAreaName"]
    return rollups.cell_summary(df, keys) if cells else rollups.value_summary(df, keys)


GRAIN = "grain"
GRAINS = {
    "all": [HABITAT, "ParameterName", "Units"],
    "program": [HABITAT, "ParameterName", "Units", "ProgramID", "ProgramName"],
    "area": [HABITAT, "ParameterName", "Units", "ManagedAreaName"],
}


def summaries(cells: DataFrame) -> DataFrame:
    """Value summaries of the habitat, its programs and its known managed areas, told apart by ``grain``."""
    out = rollups.cell_summaries(cells, GRAINS, GRAIN)
    return out.where((F.col(GRAIN) != "area") | F.col("ManagedAreaName").isNotNull())


def summary_of(grains: DataFrame, kind: str = "all") -> DataFrame:
    """One grain of ``summaries``, with the columns of ``summary``; read from a table
    partitioned by grain, only that grain's files are opened."""
    return grains.where(F.col(GRAIN) == kind).select(*GRAINS[kind], "N_samples", "mean", "min", "max")


def habitat_tables(
    cells: DataFrame, points: DataFrame, as_of, link_base: str, grains: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All habitat tables from the (preferably materialised) cells of the habitat input and
    their ``summaries``."""
    n = "n_rows"
    grains = summaries(cells) if grains is None else grains
    return {
        "programs_per_parameter": rollups.distinct_per(cells, [HABITAT, "ParameterName"], "ProgramID"),
        "program_areas": rollups.program_areas(cells, link_base),
        "program_segments": program_segments(cells, as_of),
        "location_map": location_map(cells, points, n),
        "summary_all": summary_of(grains),
        "summary_program": summary_of(grains, "program"),
        "summary_area": summary_of(grains, "area"),
        "coverage_program": coverage(cells, "program", n),
        "coverage_area": coverage(cells, "area", n),
    }
