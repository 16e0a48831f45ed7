"""Batch runs: write the reduced input once, derive and write every table from it.

The reduced tables (station-years; habitat cells) are durable Parquet, so
the derived tables neither repeat the observation scan nor depend on executor
storage.  Every run computes them anew.  The tables of a run take their names
together, when all of them are written; so what a run reads (its archive, trend
rows, monthly means) may be tables of the root that it writes to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewater.functions.semantics import null_safe_join
from tidewater.operators import clean, figures, rollups, trends
from tidewater.plans import continuous, habitat
from tidewater.sources import dimensions
from tidewater.sources.constants import PLOTS
from tidewater.sources.tables import publish, write_tables

STATION_YEARS = "station_years"
HABITAT_CELLS = "habitat_cells"
SUMMARIES = "summaries"
# What the views look up: tables are written in ranges of these columns.
STATION_CLUSTERS = {
    "station_table": ["Entity", "ProgramLocationID"],
    "station_segments": ["Entity", "ProgramLocationID"],
    "trend_rows": ["ProgramLocationID"],
    "monthly_means": ["ProgramLocationID"],
}
HABITAT_CLUSTERS = {
    name: [habitat.HABITAT]
    for name in ("program_areas", "program_segments", "location_map", "coverage_program", "coverage_area", "summary_program", "summary_area")
}


@dataclass(frozen=True)
class Archive:
    """Earlier exports from which the listed stations are taken as well."""

    stations: list
    obs: DataFrame | None = None
    stats: DataFrame | None = None
    monthly: DataFrame | None = None

    def with_earlier(self, current: DataFrame, earlier: DataFrame | None) -> DataFrame:
        return current if earlier is None else clean.backfill(current, earlier, "ProgramLocationID", self.stations)


def run_continuous(
    spark: SparkSession,
    obs: DataFrame,
    entities: DataFrame,
    stats: DataFrame,
    monthly: DataFrame,
    sites: DataFrame,
    points: DataFrame,
    root: str,
    as_of: str,
    link_base: str,
    overrides: DataFrame | None = None,
    highlights=continuous.HIGHLIGHTS,
    archive: Archive | None = None,
) -> dict[str, str]:
    """Station-years from the observations, then all continuous tables; name to path.

    ``sites`` are the habitat observations whose sampling sites get points.
    Station-years, trend rows and monthly means are completed from ``archive``.
    """
    archive = archive or Archive([])
    sy = continuous.station_years(obs)
    sy = archive.with_earlier(sy, None if archive.obs is None else continuous.station_years(archive.obs))
    silver = write_tables({STATION_YEARS: sy}, root, switch=False)
    sy = spark.read.parquet(silver[STATION_YEARS])
    stats = archive.with_earlier(stats, archive.stats)
    out = continuous.continuous_tables(sy, entities, stats, as_of, link_base, overrides, highlights)
    out |= {
        "trend_rows": stats,
        "monthly_means": archive.with_earlier(monthly, archive.monthly),
        "site_points": continuous.habitat_points(rollups.site_counts(sites), points),
    }
    paths = silver | write_tables(out, root, as_of, cluster_by=STATION_CLUSTERS, switch=False)
    publish(spark, root, paths)
    return paths


def run_habitat(
    spark: SparkSession,
    obs: DataFrame,
    thresholds: DataFrame,
    points: DataFrame,
    root: str,
    as_of: str,
    link_base: str,
    flags: dict[str, object] | None = None,
    excluded=habitat.EXCLUDED_PARAMETERS,
) -> dict[str, str]:
    """Cells of the gated rows with their units, by habitat, then all habitat tables; name to path."""
    cells = habitat.habitat_cells(obs, thresholds, flags, excluded)
    silver = write_tables({HABITAT_CELLS: cells}, root, partition_by={HABITAT_CELLS: [habitat.HABITAT]}, switch=False)
    cells = spark.read.parquet(silver[HABITAT_CELLS])
    silver |= write_tables(
        {SUMMARIES: habitat.summaries(cells)}, root, partition_by={SUMMARIES: [habitat.GRAIN]}, switch=False
    )
    tables = habitat.habitat_tables(cells, points, as_of, link_base, spark.read.parquet(silver[SUMMARIES]))
    paths = silver | write_tables(tables, root, as_of, cluster_by=HABITAT_CLUSTERS, switch=False)
    publish(spark, root, paths)
    return paths


def run_trends(
    spark: SparkSession,
    stats: dict[str, DataFrame],
    species: DataFrame,
    intervals: DataFrame,
    areas: DataFrame,
    files: DataFrame,
    root: str,
    as_of: str,
) -> dict[str, str]:
    """Classified trend tables, trend views, and the figures of every area; name to path.

    ``stats`` maps a kind (such as discrete and continuous) to its trend rows,
    usually one ``read_tables`` scan over all parameters and regions.
    """
    types = [p[0] for p in PLOTS]
    found = figures.figures_wide(figures.match_figures(areas, types, files), types)
    out = {f"trend_{kind}": trends.trend_class(df) for kind, df in stats.items()}
    out |= {
        "species_trends": trends.species_trends(species),
        "interval_trends": trends.interval_trends(intervals),
        "area_figures": null_safe_join(areas, found, ["ManagedAreaName"], "left"),
        "plots": dimensions.plots(spark),
    }
    return write_tables(out, root, as_of)
