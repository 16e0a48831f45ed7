"""Map layers: names, membership and what to show or hide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.semantics import member
from tidewater.sources.constants import HABITAT_TOKENS, STATUSES


def all_layer(status: Column) -> Column:
    return F.concat(F.lit("All_"), status)


def entity_layer(entity: Column, status: Column) -> Column:
    return F.concat(entity, F.lit("_by_entity_"), status)


def assign_layers(df: DataFrame) -> DataFrame:
    """Each marker goes to the layer of its status and to the one of its entity and status."""
    entity, status = F.col("Entity"), F.col("Status")
    layers = F.array(all_layer(status), entity_layer(entity, status))
    return df.withColumn("layer", F.explode(layers)).where(F.col("layer").isNotNull())


def habitat_layers(points: DataFrame, tokens: list[str] = HABITAT_TOKENS) -> DataFrame:
    """Habitat points with a known token, layer named by the token; case is ignored."""
    token = F.upper("habitat")
    return points.where(token.isin([t.upper() for t in tokens])).withColumn("layer", token)


def layer_grid(entities: DataFrame, statuses: list[str] = STATUSES) -> DataFrame:
    """Every entity layer, the statuses being unfolded inside each entity row."""
    rows = entities.select("Entity").distinct()
    rows = rows.select("Entity", F.explode(F.array(*[F.lit(s) for s in statuses])).alias("Status"))
    return rows.select("*", entity_layer(F.col("Entity"), F.col("Status")).alias("layer"))


def layer_diff(all_layers: DataFrame, shown: DataFrame) -> DataFrame:
    """Layers to hide."""
    return all_layers.select("layer").subtract(shown.select("layer"))


def layer_visibility(
    entities: DataFrame, entity: str, shown: list[str], statuses: list[str] = STATUSES
) -> DataFrame:
    """Every marker layer with whether it is on the map.

    The choice ``All`` shows the status layers of all entities, any other
    choice the layers of that entity; ``shown`` holds the ticked statuses.
    """
    rows = layer_grid(entities, statuses)
    whole = rows.select(F.lit("All").alias("Entity"), "Status", all_layer(F.col("Status")).alias("layer")).distinct()
    on = (F.col("Entity") == entity) & member("Status", shown)
    return rows.unionByName(whole).withColumn("visible", on)


def layer_lists(df: DataFrame, all_col: str, shown_col: str) -> DataFrame:
    """List form: hidden layers, and the union of both lists."""
    return df.select(
        "*",
        F.array_except(all_col, shown_col).alias("hidden"),
        F.array_union(all_col, shown_col).alias("every"),
    )
