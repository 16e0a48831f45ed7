"""Enrichment of observations and summaries with dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.semantics import choosing, member, null_safe_join
from tidewater.functions.text import detail_link


def attach_entity(
    df: DataFrame,
    dim: DataFrame,
    highlights: list[str],
    link_base: str,
    always_linked: list[str] | None = None,
    key: str = "ProgramID",
    station: str = "ProgramLocationID",
) -> DataFrame:
    """Add ``Entity``, ``link`` and ``link2`` by program.

    A program without an entity is its own entity.  ``link2`` is only set for
    entities that are not highlighted.  Rows without a station are dropped; a
    dimension row without observations can only produce such rows, hence a left
    join from the observations.
    """
    if "ProgramName" in dim.columns:
        dim = dim.withColumn("Entity", F.coalesce("Entity", "ProgramName"))
    link = detail_link(link_base, F.col(key))
    dim = dim.select(
        key,
        "Entity",
        link.alias("link"),
        F.when(~member("Entity", highlights), link).alias("link2"),
    )
    out = null_safe_join(df.where(F.col(station).isNotNull()), dim, [key], "left")
    out = out.withColumn("Entity", F.coalesce("Entity", "ProgramName"))
    if always_linked:
        out = out.withColumn("link", F.when(member("Entity", always_linked), link).otherwise(F.col("link")))
    return out


def attach_trend(detail: DataFrame, stats: DataFrame) -> DataFrame:
    """Sufficiency and number of years per (station, parameter); one row per trend row."""
    stats = stats.select("ProgramLocationID", "ParameterName", "SufficientData", "N_Years")
    return null_safe_join(detail, stats, ["ProgramLocationID", ("Parameter", "ParameterName")])


def attach_points(df: DataFrame, points: DataFrame, on: list[str | tuple[str, str]]) -> DataFrame:
    """Coordinates for the rows that have a point."""
    return null_safe_join(df, points, on)


def attach_units(df: DataFrame, thresholds: DataFrame, habitat: str | None = None) -> DataFrame:
    """Units by (ParameterName, Habitat); a duplicated threshold multiplies its rows.

    ``habitat`` is a display name and restricts the thresholds to it.
    """
    if habitat is not None:
        thresholds = thresholds.where(F.col("Habitat") == threshold_habitat(F.lit(habitat)))
    return null_safe_join(df, thresholds, ["ParameterName", "Habitat"])


def threshold_habitat(habitat: Column) -> Column:
    """Habitat display name as the thresholds spell it."""
    doubled = F.concat_ws("/", F.split(habitat, " ")[0], habitat)
    return (
        F.when(habitat == "Nekton", "Water Column")
        .when(member(habitat, ["Oyster Reef", "Coral Reef"]), doubled)
        .otherwise(habitat)
    )


def habitat_name(habitat: Column) -> Column:
    """Display name of a habitat as the thresholds spell it."""
    return F.when(habitat == "Water Column", "Nekton").otherwise(F.element_at(F.split(habitat, "/"), -1))


def known_only(df: DataFrame, known: DataFrame, on: list[str | tuple[str, str]]) -> DataFrame:
    """Rows whose key occurs in the other table."""
    key = on[0] if isinstance(on[0], str) else on[0][1]
    return null_safe_join(df, choosing(known, key), on, "left_semi")


def lookup(df: DataFrame, dim: DataFrame, on: list[str | tuple[str, str]], cols: list[str]) -> DataFrame:
    """Add columns of a dimension, null when the key is unknown."""
    keys = [k if isinstance(k, str) else k[1] for k in on]
    return null_safe_join(df, dim.select(*keys, *cols), on, "left")
