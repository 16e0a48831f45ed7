"""Monitoring-shaped tables derived from the driver tables, in Spark and in SQL.

Suppliers play stations, nations programs, regions managed areas, part types
parameters and order lines observations.  Nulls and partial dimensions are
made from column values, since the driver tables have none.  Programs have years
without data and some ended years ago; a third of the stations is sampled in two
habitats; locations of the habitat input are few, so that its cells are too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from tidewater.plans import continuous, habitat

AS_OF = "2002-12-31"
LINK = "https://example.org/programs/"
HIGHLIGHTS = ["GROUP_ASIA", "GROUP_AMERICA"]
FLAGS = {"Include": "F", "MADup": 1}


# Years move so that each program misses every third year and one in four programs is historical.
YEAR = (
    "year(l_shipdate) - CASE WHEN n_nationkey % 4 = 1 THEN 5 ELSE 0 END"
    " - CASE WHEN (n_nationkey + year(l_shipdate)) % 3 = 0 THEN 1 ELSE 0 END"
)
HABITAT = (
    "CASE WHEN l_suppkey % 3 = 0 THEN 'Water Column' WHEN l_suppkey % 3 = 1 OR l_returnflag = 'A'"
    " THEN 'Oyster/Oyster Reef' ELSE 'Submerged Aquatic Vegetation' END"
)
HABITATS = ["Water Column", "Oyster/Oyster Reef", "Submerged Aquatic Vegetation"]

# Declared, so that no job is run to infer them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def obs(spark, sf) -> DataFrame:
    """Observations: order lines with the dimensions joined one by one.

    Left-deep on purpose: each dimension is judged by its own size, so the
    small ones are broadcast and only a large one shuffles the lines.
    """
    part, supplier, nation, region = (table(spark, sf, t) for t in ("part", "supplier", "nation", "region"))
    rows = (
        table(spark, sf, "lineitem")
        .join(part, F.expr("l_partkey = p_partkey"))
        .join(supplier, F.expr("l_suppkey = s_suppkey"))
        .join(nation, F.expr("s_nationkey = n_nationkey"))
        .join(region, F.expr("n_regionkey = r_regionkey"))
    )
    return rows.selectExpr(
        "l_suppkey AS ProgramLocationID",
        "l_partkey AS LocationID",
        "n_nationkey AS ProgramID",
        "n_name AS ProgramName",
        "nullif(r_name, 'ASIA') AS ManagedAreaName",
        "r_name AS Region",
        "s_acctbal / 1000 AS OriginalLatitude",
        "-s_acctbal / 500 AS OriginalLongitude",
        "p_type AS ParameterName",
        "concat('u_', p_type) AS ParameterUnits",
        f"{HABITAT} AS Habitat",
        "l_returnflag AS ActivityType",
        f"CAST({YEAR} AS INT) AS Year",
        "l_quantity AS ResultValue",
        "nullif(l_discount, 0.0D) AS SparseValue",
        "l_linestatus AS Include",
        "CASE WHEN l_tax > 0 THEN 1 ELSE 0 END AS MADup",
    )


OBS = f"""obs AS (
  SELECT l.l_suppkey AS ProgramLocationID, l.l_partkey AS LocationID, n.n_nationkey AS ProgramID,
         n.n_name AS ProgramName, nullif(r.r_name, 'ASIA') AS ManagedAreaName, r.r_name AS Region,
         s.s_acctbal / 1000 AS OriginalLatitude, -s.s_acctbal / 500 AS OriginalLongitude,
         p.p_type AS ParameterName, 'u_' || p.p_type AS ParameterUnits, {HABITAT} AS Habitat,
         l.l_returnflag AS ActivityType, CAST({YEAR} AS INTEGER) AS Year,
         l.l_quantity AS ResultValue, nullif(l.l_discount, 0.0) AS SparseValue,
         l.l_linestatus AS Include, CASE WHEN l.l_tax > 0 THEN 1 ELSE 0 END AS MADup
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def dim_entity(spark, sf) -> DataFrame:
    """Partial on purpose: no program of one region, no entity for another."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = n.join(r, F.expr("n_regionkey = r_regionkey AND r_name <> 'EUROPE'"))
    return rows.selectExpr(
        "n_nationkey AS ProgramID",
        "n_name AS ProgramName",
        "CASE WHEN r_name <> 'MIDDLE EAST' THEN concat('GROUP_', r_name) END AS Entity",
    )


DIM_ENTITY = f"""dim_entity AS (
  SELECT ProgramID, Entity, '{LINK}' || ProgramID AS link,
         CASE WHEN Entity NOT IN ('GROUP_ASIA', 'GROUP_AMERICA') THEN '{LINK}' || ProgramID END AS link2
  FROM (SELECT n_nationkey AS ProgramID,
               CASE WHEN r_name <> 'MIDDLE EAST' THEN 'GROUP_' || r_name ELSE n_name END AS Entity
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE'))"""


def station_years(spark, sf) -> DataFrame:
    return continuous.station_years(obs(spark, sf))


SY = """sy AS (
  SELECT * EXCLUDE (n), CAST(sum(n) OVER (PARTITION BY ProgramLocationID, Year, Parameter, Region) AS BIGINT) AS Data_N
  FROM (SELECT ProgramLocationID, Year, ParameterName AS Parameter, Region, ProgramID, ProgramName, ManagedAreaName,
               ParameterUnits AS Units, OriginalLatitude AS Lat, OriginalLongitude AS Lon, count(*) AS n
        FROM obs GROUP BY ALL))"""


def entity_years(spark, sf) -> DataFrame:
    sy = station_years(spark, sf)
    return continuous.entity_station_years(sy, dim_entity(spark, sf), LINK, HIGHLIGHTS, ["NATION_3"])


def entity_presence(spark, sf) -> DataFrame:
    seen = continuous.presence(obs(spark, sf))
    return continuous.entity_station_years(seen, dim_entity(spark, sf), LINK, HIGHLIGHTS, ["NATION_3"])


EY = f"""ey AS (
  SELECT sy.*, coalesce(d.Entity, sy.ProgramName) AS Entity,
         CASE WHEN coalesce(d.Entity, sy.ProgramName) = 'NATION_3' THEN '{LINK}' || sy.ProgramID ELSE d.link END AS link,
         d.link2
  FROM sy LEFT JOIN dim_entity d ON sy.ProgramID IS NOT DISTINCT FROM d.ProgramID
  WHERE sy.ProgramLocationID IS NOT NULL)"""


def thresholds(spark, sf) -> DataFrame:
    """Units per parameter and habitat: one parameter missing, one missing in a habitat, one duplicated."""
    types = table(spark, sf, "part").where("p_type <> 'PROMO'").select(F.col("p_type").alias("ParameterName")).distinct()
    every = types.withColumn("Habitat", F.explode(F.array(*[F.lit(h) for h in HABITATS])))
    once = every.where("NOT (ParameterName = 'MEDIUM' AND Habitat LIKE 'Sub%')")
    twice = every.where("ParameterName = 'LARGE' AND Habitat LIKE 'Oyster%'")
    return once.withColumn("Units", F.expr("concat('u_', ParameterName)")).unionByName(
        twice.withColumn("Units", F.expr("concat('u2_', ParameterName)"))
    )


THRESHOLDS = """thresholds AS (
  SELECT DISTINCT p_type AS ParameterName, h AS Habitat, 'u_' || p_type AS Units
  FROM part, (VALUES ('Water Column'), ('Oyster/Oyster Reef'), ('Submerged Aquatic Vegetation')) AS t(h)
  WHERE p_type <> 'PROMO' AND NOT (p_type = 'MEDIUM' AND h LIKE 'Sub%')
  UNION ALL
  SELECT DISTINCT p_type, 'Oyster/Oyster Reef', 'u2_' || p_type FROM part WHERE p_type = 'LARGE')"""


def habitat_obs(spark, sf) -> DataFrame:
    """Observations with a few sampling locations, each shared by several stations."""
    return obs(spark, sf).withColumn("LocationID", F.col("ProgramLocationID") % 7)


def habitat_input(spark, sf) -> DataFrame:
    return habitat.habitat_input(habitat_obs(spark, sf), thresholds(spark, sf), FLAGS, ["SMALL"])


def habitat_cells(spark, sf) -> DataFrame:
    return habitat.habitat_cells(habitat_obs(spark, sf), thresholds(spark, sf), FLAGS, ["SMALL"])


HAB = """hab AS (
  SELECT obs.* REPLACE (ProgramLocationID % 7 AS LocationID), t.Units FROM obs JOIN thresholds t
    ON obs.ParameterName IS NOT DISTINCT FROM t.ParameterName AND obs.Habitat IS NOT DISTINCT FROM t.Habitat
  WHERE Include = 'F' AND MADup = 1 AND obs.ParameterName IS DISTINCT FROM 'SMALL')"""

# A habitat's display name, as the tables' tag.
HABITAT_NAME = """CASE Habitat WHEN 'Water Column' THEN 'Nekton' WHEN 'Oyster/Oyster Reef' THEN 'Oyster Reef'
       WHEN 'Coral/Coral Reef' THEN 'Coral Reef' ELSE Habitat END"""


def points(spark, sf) -> DataFrame:
    """Positions of the stations with a positive balance."""
    return table(spark, sf, "supplier").where("s_acctbal > 0").selectExpr(
        "s_suppkey AS ProgramLoc", "s_nationkey AS ProgramID", "s_acctbal / 1000 AS lat", "-s_acctbal / 500 AS lon"
    )


POINTS = """points AS (
  SELECT s_suppkey AS ProgramLoc, s_nationkey AS ProgramID, s_acctbal / 1000 AS lat, -s_acctbal / 500 AS lon
  FROM supplier WHERE s_acctbal > 0)"""


def location_points(spark, sf) -> DataFrame:
    """Positions per (station, program, sampling location)."""
    lines = table(spark, sf, "lineitem").selectExpr("l_suppkey AS ProgramLoc", "l_suppkey % 7 AS LocationID")
    return lines.distinct().join(points(spark, sf), "ProgramLoc")


LOCATION_POINTS = POINTS + """, location_points AS (
  SELECT p.*, l.LocationID
  FROM (SELECT DISTINCT l_suppkey AS ProgramLoc, l_suppkey % 7 AS LocationID FROM lineitem) l JOIN points p USING (ProgramLoc))"""


def typed_lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))


def trend_rows(spark, sf) -> DataFrame:
    """Trend statistics per station, parameter and activity, every outcome occurring."""
    columns = {
        "N_Years": "count(DISTINCT year(l_shipdate))",
        "EarliestYear": "min(year(l_shipdate))",
        "LatestYear": "max(year(l_shipdate))",
        "EarliestSampleDate": "min(to_date(l_shipdate))",
        "LastSampleDate": "max(to_date(l_shipdate))",
        "p": "CASE WHEN count_if(l_quantity >= 48) > 0 THEN count_if(l_tax = 0) / 80.0D END",
        "SennSlope": "CASE WHEN count_if(l_quantity >= 45 AND l_quantity < 48) > 0 "
        "THEN (count_if(l_quantity <= 25) - count_if(l_quantity > 25)) / 100.0D END",
        "SennIntercept": "count_if(l_quantity < 10) / 4.0D",
        "SufficientData": "count_if(l_quantity >= 42 AND l_quantity < 45) > 0",
        "Trend": "CASE WHEN count_if(l_quantity >= 39 AND l_quantity < 42) > 0 THEN 1 END",
    }
    rows = typed_lines(spark, sf).groupBy("l_suppkey", "p_type", "l_returnflag").agg(
        *[F.expr(f"{text} AS {name}") for name, text in columns.items()]
    )
    return rows.selectExpr(
        "l_suppkey AS ProgramLocationID",
        "p_type AS ParameterName",
        "concat_ws('-', l_suppkey, p_type, l_returnflag) AS MonitoringID",
        *columns,
    )


TREND_ROWS = """trend_rows AS (
  SELECT l_suppkey AS ProgramLocationID, p_type AS ParameterName,
         l_suppkey || '-' || p_type || '-' || l_returnflag AS MonitoringID,
         count(DISTINCT year(l_shipdate)) AS N_Years, CAST(min(year(l_shipdate)) AS INTEGER) AS EarliestYear,
         CAST(max(year(l_shipdate)) AS INTEGER) AS LatestYear,
         CAST(min(l_shipdate) AS DATE) AS EarliestSampleDate, CAST(max(l_shipdate) AS DATE) AS LastSampleDate,
         CASE WHEN count_if(l_quantity >= 48) > 0 THEN count_if(l_tax = 0) / 80.0::DOUBLE END AS p,
         CASE WHEN count_if(l_quantity >= 45 AND l_quantity < 48) > 0
              THEN (count_if(l_quantity <= 25) - count_if(l_quantity > 25)) / 100.0::DOUBLE END AS SennSlope,
         count_if(l_quantity < 10) / 4.0::DOUBLE AS SennIntercept,
         count_if(l_quantity >= 42 AND l_quantity < 45) > 0 AS SufficientData,
         CASE WHEN count_if(l_quantity >= 39 AND l_quantity < 42) > 0 THEN 1 END AS Trend
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_type, l_returnflag)"""


def intervals(spark, sf) -> DataFrame:
    """Interval estimates per customer, with blank and missing fields."""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
    return rows.selectExpr(
        "c_custkey AS id",
        "n_name AS ManagedAreaName",
        "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Density' WHEN 'BUILDING' THEN 'Shell Height' "
        "ELSE 'Percent Live' END AS ParameterName",
        "c_mktsegment AS ShellType",
        "lower(c_mktsegment) AS HabitatType",
        "CASE WHEN c_acctbal < 2000 THEN '' WHEN c_acctbal < 6000 THEN '25-75mm' ELSE '>75mm' END AS SizeClass",
        "CASE WHEN NOT (c_acctbal > 1000 AND c_acctbal < 2500) THEN round(c_acctbal / 1000 - 4, 3) END AS ModelEstimate",
        "round(c_acctbal / 9000, 3) AS StandardError",
        "CASE WHEN c_mktsegment <> 'MACHINERY' THEN round(c_acctbal / 1000 - 6, 3) END AS LowerConfidence",
        "round(c_acctbal / 1000 - 2, 3) AS UpperConfidence",
        "n_regionkey > 1 AS SufficientData",
    )


INTERVALS = """intervals AS (
  SELECT c_custkey AS id, n_name AS ManagedAreaName,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Density' WHEN 'BUILDING' THEN 'Shell Height' ELSE 'Percent Live' END AS ParameterName,
         c_mktsegment AS ShellType, lower(c_mktsegment) AS HabitatType,
         CASE WHEN c_acctbal < 2000 THEN '' WHEN c_acctbal < 6000 THEN '25-75mm' ELSE '>75mm' END AS SizeClass,
         CASE WHEN NOT (c_acctbal > 1000 AND c_acctbal < 2500) THEN round(c_acctbal / 1000 - 4, 3) END AS ModelEstimate,
         round(c_acctbal / 9000, 3) AS StandardError,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN round(c_acctbal / 1000 - 6, 3) END AS LowerConfidence,
         round(c_acctbal / 1000 - 2, 3) AS UpperConfidence, n_regionkey > 1 AS SufficientData
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def monthly(spark, sf) -> DataFrame:
    """Monthly means per station and parameter."""
    rows = typed_lines(spark, sf).selectExpr(
        "l_suppkey AS ProgramLocationID",
        "p_type AS ParameterName",
        "year(l_shipdate) AS Year",
        "year(l_shipdate) + (month(l_shipdate) - 1) / 12.0D AS YearMonthDec",
        "l_quantity",
    )
    keys = ["ProgramLocationID", "ParameterName", "Year", "YearMonthDec"]
    return rows.groupBy(*keys).agg(F.avg("l_quantity").alias("Mean"))


MONTHLY = """monthly AS (
  SELECT l_suppkey AS ProgramLocationID, p_type AS ParameterName, CAST(year(l_shipdate) AS INTEGER) AS Year,
         year(l_shipdate) + (month(l_shipdate) - 1) / 12.0::DOUBLE AS YearMonthDec, avg(l_quantity) AS Mean
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ENTITY_CTES = (OBS, SY, DIM_ENTITY, EY)
HABITAT_CTES = (OBS, THRESHOLDS, HAB)


def r_round(x: str, digits: int) -> str:
    """SQL for rounding to the closer of the two neighbours, ties to the even one."""
    s = f"{10 ** digits}.0::DOUBLE"
    lo, hi = f"(floor(({x}) * {s}) / {s})", f"(ceil(({x}) * {s}) / {s})"
    return (
        f"CASE WHEN ({x}) - {lo} < {hi} - ({x}) THEN {lo} WHEN ({x}) - {lo} > {hi} - ({x}) THEN {hi} "
        f"WHEN floor(({x}) * {s}) % 2 = 0 THEN {lo} ELSE {hi} END"
    )


def segment_ctes(name: str, source: str, keys: str, year: str = "Year") -> str:
    """Reference-mode segments of ``source`` per ``keys`` as CTE ``name``."""
    return f"""{name}_gaps AS (
  SELECT *, lead(y) OVER (PARTITION BY {keys} ORDER BY y) AS nxt, min(y) OVER (PARTITION BY {keys}) AS first_y
  FROM (SELECT DISTINCT {keys}, {year} AS y FROM {source} WHERE {year} IS NOT NULL)),
{name} AS (
  SELECT {keys}, coalesce(lag(y) OVER (PARTITION BY {keys} ORDER BY y) + 1, first_y) AS startYear,
         CASE WHEN nxt IS NULL THEN y ELSE y - 1 END AS endYear
  FROM {name}_gaps WHERE nxt IS NULL OR nxt - y <> 1)"""


def status_sql(year: str, cutoff: int = 2001) -> str:
    return f"CASE WHEN {year} IS NULL THEN NULL WHEN {year} >= {cutoff} THEN 'Active' ELSE 'Historical' END"


