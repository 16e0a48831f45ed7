"""Area extents and statistics."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog import query
from tidewater.operators import areas


def vertices(spark, sf):
    return X.table(spark, sf, "embeddings").select(
        F.col("label").alias("area"),
        F.col("embedding")[0].cast("double").alias("lon"),
        F.col("embedding")[1].cast("double").alias("lat"),
    )


_VERTICES = "SELECT label AS area, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings"


@query("o105_area_vertices", f"SELECT * FROM ({_VERTICES}) WHERE area = 3")
def area_vertices(spark, sf):
    return areas.select_area(vertices(spark, sf), 3)


@query("o106_area_bbox", f"""
SELECT area, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM ({_VERTICES}) GROUP BY area""")
def area_bbox(spark, sf):
    return areas.area_bbox(vertices(spark, sf))


@query("o108_area_stats", X.with_(X.OBS) + """, d AS (
  SELECT * FROM obs WHERE SparseValue IS NOT NULL AND ManagedAreaName IS NOT NULL),
g AS (
  SELECT ManagedAreaName, ParameterName, count(DISTINCT Year) AS N_Years, min(Year) AS EarliestYear, max(Year) AS LatestYear,
         min(SparseValue) AS Min, max(SparseValue) AS Max, count(*) AS N_Data, round(avg(SparseValue), 8) AS Mean,
         round(stddev_samp(SparseValue), 8) AS StandardDeviation, round(median(SparseValue), 8) AS Median,
         string_agg(DISTINCT ProgramName, ', ' ORDER BY ProgramName) AS Programs,
         array_to_string(list_sort(list(DISTINCT ProgramID)), ', ') AS ProgramIDs
  FROM d GROUP BY ALL),
e AS (
  SELECT ManagedAreaName,
         min(Year) FILTER (WHERE SparseValue = lo) AS Year_MinRichness, min(Year) FILTER (WHERE SparseValue = hi) AS Year_MaxRichness
  FROM (SELECT *, min(SparseValue) OVER (PARTITION BY ManagedAreaName) AS lo,
                  max(SparseValue) OVER (PARTITION BY ManagedAreaName) AS hi FROM d) GROUP BY ManagedAreaName)
SELECT r_name AS ManagedAreaName, g.* EXCLUDE (ManagedAreaName, N_Years, N_Data),
       coalesce(N_Years, 0) AS N_Years, coalesce(N_Data, 0) AS N_Data, Year_MinRichness, Year_MaxRichness
FROM region LEFT JOIN g ON r_name = g.ManagedAreaName LEFT JOIN e ON r_name = e.ManagedAreaName""")
def area_stats(spark, sf):
    all_areas = X.table(spark, sf, "region").select(F.col("r_name").alias("ManagedAreaName"))
    out = areas.area_stats(X.obs(spark, sf), all_areas, ["ParameterName"], value="SparseValue")
    return out.withColumns({c: F.round(c, 8) for c in ("Mean", "StandardDeviation", "Median")})


@query("o108_exact_median", """
SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS Median FROM lineitem GROUP BY ALL""")
def exact_median(spark, sf):
    out = areas.exact_median(X.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.withColumn("Median", F.round("Median", 4))
