"""Map layers."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog import query
from tidewater.operators import layers, rollups
from tidewater.plans import continuous

_MARKS = X.with_(*X.ENTITY_CTES) + f""", marks AS (
  SELECT ProgramLocationID, Entity, {X.status_sql('max(Year)')} AS Status FROM ey GROUP BY ALL),
layered AS (SELECT *, unnest(['All_' || Status, Entity || '_by_entity_' || Status]) AS layer FROM marks),
grid AS (SELECT Entity, Status, Entity || '_by_entity_' || Status AS layer
         FROM (SELECT DISTINCT Entity FROM ey), (VALUES ('Active'), ('Historical')) s(Status))
"""


def _marks(spark, sf):
    return continuous.station_status(X.entity_presence(spark, sf), X.AS_OF).select(
        "ProgramLocationID", "Entity", "Status"
    )


@query("o70_assign_layers", _MARKS + "SELECT * FROM layered WHERE layer IS NOT NULL")
def assign_layers(spark, sf):
    return layers.assign_layers(_marks(spark, sf))


@query("o70_habitat_layers", X.with_(X.OBS, X.POINTS) + """
SELECT s.Habitat AS habitat, p.ProgramLoc, upper(s.Habitat) AS layer
FROM points p JOIN (SELECT DISTINCT Habitat, ProgramLocationID FROM obs) s ON p.ProgramLoc = s.ProgramLocationID
WHERE s.Habitat <> 'Submerged Aquatic Vegetation'""")
def habitat_layers(spark, sf):
    sites = rollups.site_counts(X.obs(spark, sf).withColumnRenamed("Habitat", "habitat"))
    pts = continuous.habitat_points(sites, X.points(spark, sf)).select("habitat", "ProgramLoc")
    return layers.habitat_layers(pts, ["water column", "Oyster/Oyster Reef"])


@query("o71_layer_grid", _MARKS + "SELECT * FROM grid")
def layer_grid(spark, sf):
    return layers.layer_grid(X.entity_presence(spark, sf))


@query("o66_hidden_layers", _MARKS + "SELECT layer FROM grid EXCEPT SELECT layer FROM layered")
def hidden_layers(spark, sf):
    shown = layers.assign_layers(_marks(spark, sf))
    return layers.layer_diff(layers.layer_grid(X.entity_presence(spark, sf)), shown)


@query("o66_layer_visibility", _MARKS + """
SELECT Entity, Status, layer, Entity = 'GROUP_ASIA' AND Status = 'Active' AS visible FROM grid
UNION ALL SELECT 'All', Status, 'All_' || Status, false FROM (VALUES ('Active'), ('Historical')) s(Status)""")
def layer_visibility(spark, sf):
    return layers.layer_visibility(X.entity_presence(spark, sf), "GROUP_ASIA", ["Active"])


@query("o66_layer_lists", X.with_(X.OBS) + """, l AS (
  SELECT LocationID, list_sort(list(DISTINCT ParameterName)) AS a,
         list_sort(list(DISTINCT ParameterName) FILTER (WHERE Year >= 2000)) AS s FROM obs GROUP BY LocationID)
SELECT LocationID, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(coalesce(s, []), x))), ', ') AS hidden,
       array_to_string(a, ', ') AS every FROM l""")
def layer_lists(spark, sf):
    late = F.when(F.col("Year") >= 2000, F.col("ParameterName"))
    rows = X.obs(spark, sf).select("LocationID", "ParameterName", late.alias("late")).distinct()
    rows = rows.groupBy("LocationID").agg(
        F.sort_array(F.collect_set("ParameterName")).alias("a"), F.sort_array(F.collect_set("late")).alias("s")
    )
    out = layers.layer_lists(rows, "a", "s")
    text = lambda c: F.array_join(F.sort_array(c), ", ").alias(c)
    return out.select("LocationID", text("hidden"), text("every"))


@query("o70_marker_layers", X.with_(*X.ENTITY_CTES) + f""", m AS (
  SELECT ProgramLocationID, ProgramID, ProgramName, Entity, max(Year) AS y, CAST(sum(Data_N) AS BIGINT) AS n,
         array_to_string(list_sort(list(DISTINCT Year)), ', ') AS years,
         array_to_string(list_sort(list(DISTINCT Parameter)), ', ') AS params FROM ey GROUP BY ALL),
t AS (SELECT *, {X.status_sql('y')} AS Status,
        '<br> <b>ProgLocID</b>: ' || ProgramLocationID || '<br> <b>ProgramName</b> (ID): ' || ProgramName || ' (' || ProgramID ||
        ')<br> <b>Data_N</b>: ' || format('{{:,}}', n) || '<br> <b>Years</b>: ' || years || '<br> <b>Params</b>: ' || params AS popup
      FROM m)
SELECT CAST(ProgramLocationID AS VARCHAR) AS label, popup, unnest(['All_' || Status, Entity || '_by_entity_' || Status]) AS layer FROM t""")
def marker_layers(spark, sf):
    marks = continuous.station_markers(X.entity_years(spark, sf), X.AS_OF)
    return layers.assign_layers(marks).select("label", "popup", "layer")
