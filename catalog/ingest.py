"""Sources and sinks: tables derived from the driver tables are written and read back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import fixtures as X
from catalog import query
from tidewater.functions.semantics import null_safe_join
from tidewater.functions.text import id_part
from tidewater.operators import clean
from tidewater.operators.joins import habitat_name, lookup
from tidewater.plans import partials
from tidewater.sources import readers, tables
from tidewater.sources.constants import INPUT_RULES, PARAMETER_UNITS, PLOTS
from tidewater.sources.dimensions import (
    columns,
    dimension,
    input_rules,
    parameter_units,
    plots,
    read_dimension,
)
from tidewater.sources.scratch import scratch_path

OBS = X.with_(X.OBS)


def schema(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


def export(spark, df, label: str, sep: str, null: str = "", partition_by=()):
    path = scratch_path(spark, label)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.options(header=True, sep=sep, nullValue=null, emptyValue="").csv(path)
    return path


@query("o01_delimited_scan", OBS + """
SELECT ParameterName, Year, count(*) AS n, CAST(sum(ResultValue) AS BIGINT) AS total,
       count(SparseValue) AS known, count(ManagedAreaName) AS located
FROM obs GROUP BY ALL""")
def delimited_scan(spark, sf):
    rows = X.obs(spark, sf).select("ProgramLocationID", "ParameterName", "ManagedAreaName", "Year", "ResultValue", "SparseValue")
    path = export(spark, rows, "observations", "|", "NULL")
    back = readers.read_delim(
        spark, path, schema("ManagedAreaName string, ParameterName string, Year int, ResultValue double, SparseValue double")
    )
    return back.groupBy("ParameterName", "Year").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("ResultValue").cast("bigint").alias("total"),
        F.count("SparseValue").alias("known"),
        F.count("ManagedAreaName").alias("located"),
    )


@query("o02_statistics_scan", X.with_(X.TREND_ROWS) + """
SELECT MonitoringID, N_Years, EarliestSampleDate, p, SennSlope, SufficientData FROM trend_rows""")
def statistics_scan(spark, sf):
    path = export(spark, X.trend_rows(spark, sf), "trend-statistics", "|")
    spec = "MonitoringID string, N_Years bigint, EarliestSampleDate date, p double, SennSlope double, SufficientData boolean"
    return readers.read_delim(spark, path, schema(spec), null=None)


@query("o03_comma_scan", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def comma_scan(spark, sf):
    path = export(spark, X.table(spark, sf, "supplier"), "areas", ",")
    spec = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
    return readers.read_delim(spark, path, schema(spec), sep=",", null=None)


def _tokens(spark, sf):
    """Observations under folders named like export files: All_<habitat>_<activity>."""
    name = F.concat_ws("_", F.lit("All"), "Habitat", "ActivityType")
    rows = X.obs(spark, sf).select("ProgramLocationID", "Year", "ResultValue", name.alias("export"))
    return export(spark, rows, "exports", "|", "NULL", ["export"])


@query("o04_file_selection", OBS + """
SELECT Year, count(*) AS n FROM obs WHERE Habitat = 'Water Column' AND ActivityType <> 'N' GROUP BY ALL""")
def file_selection(spark, sf):
    path = _tokens(spark, sf)
    rows = readers.read_delim(spark, path, schema("Year int"), include="All_Water", exclude="_N/")
    return rows.groupBy("Year").agg(F.count(F.lit(1)).alias("n"))


@query("o04_mixed_layouts", OBS + """
SELECT 'cont' AS kind, Year, count(*) AS n, CAST(sum(ResultValue) AS BIGINT) AS total, CAST(NULL AS BIGINT) AS located
FROM obs GROUP BY Year
UNION ALL
SELECT 'All', Year, count(*), CAST(sum(ResultValue) AS BIGINT), count(ManagedAreaName) FROM obs GROUP BY Year""")
def mixed_layouts(spark, sf):
    """One folder with exports of two layouts, read together and told apart by name."""
    root = scratch_path(spark, "mixed")
    rows = X.obs(spark, sf)
    for name, cols in (("WQ_cont_DO", ["ResultValue", "Year"]), ("All_OYSTER", ["Year", "ManagedAreaName", "ResultValue"])):
        rows.select(*cols).write.options(header=True, sep="|", nullValue="NULL", emptyValue="").csv(f"{root}/{name}")
    back = readers.read_delim(
        spark, root, schema("Year int, ResultValue double, ManagedAreaName string"), include=["^WQ|^All"], with_file=True
    )
    kind = F.when(F.contains(F.col(readers.FILE), F.lit("_cont_")), "cont").otherwise("All").alias("kind")
    located = F.when(F.col("kind") == "All", F.col("located")).alias("located")
    out = back.groupBy(kind, "Year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ResultValue").cast("bigint").alias("total"),
        F.count("ManagedAreaName").alias("located"),
    )
    return out.select("kind", "Year", "n", "total", located)


@query("o05_habitat_from_file", OBS + """
SELECT Habitat AS habitat, ProgramLocationID, count(*) AS N_Data FROM obs GROUP BY ALL""")
def habitat_from_file(spark, sf):
    rows = readers.read_delim(spark, _tokens(spark, sf), schema("ProgramLocationID bigint"), with_file=True)
    # Folder names of partitions escape what a path cannot hold.
    habitat = F.url_decode(id_part(F.col(readers.FILE), 1, -1)).alias("habitat")
    return rows.groupBy(habitat, "ProgramLocationID").agg(F.count(F.lit(1)).alias("N_Data"))


@query("o06_multi_table_scan", X.with_(X.OBS, X.SY) + """
SELECT Parameter, Region, CAST(sum(Data_N) AS BIGINT) AS Data_N, count(*) AS n FROM sy GROUP BY ALL""")
def multi_table_scan(spark, sf):
    sy = X.station_years(spark, sf)
    paths = tables.write_tables(
        {"early": sy.where("Year < 1998"), "late": sy.where("Year >= 1998")}, scratch_path(spark, "parts")
    )
    rows = readers.read_tables(spark, list(paths.values()))
    return rows.groupBy("Parameter", "Region").agg(F.sum("Data_N").alias("Data_N"), F.count(F.lit(1)).alias("n"))


@query("o09_last_export_wins", X.with_(X.OBS, X.SY) + """
SELECT Parameter, Region, CAST(sum(Data_N) AS BIGINT) AS Data_N FROM sy
WHERE (Region <> 'ASIA' AND Year >= 1998)
   OR (Parameter, Region) NOT IN (SELECT (Parameter, Region) FROM sy WHERE Region <> 'ASIA' AND Year >= 1998)
GROUP BY ALL""")
def last_export_wins(spark, sf):
    sy = X.station_years(spark, sf)
    newer = sy.where((F.col("Region") != "ASIA") & (F.col("Year") >= 1998))
    paths = tables.write_tables({"export_1": sy, "export_2": newer}, scratch_path(spark, "exports"))
    rows = readers.read_tables(spark, list(paths.values()), "last", ["Parameter", "Region"], r"export_\d+")
    return rows.groupBy("Parameter", "Region").agg(F.sum("Data_N").alias("Data_N"))


RULES = [
    ("LARGE", "A", "Oyster/Oyster Reef"), ("SMALL", "N", "Water Column"), ("PROMO", "R", "Submerged Aquatic Vegetation"),
]
_RULES = "(VALUES " + ", ".join(map(str, RULES)) + ") r(param, activity, depth)"


def _inputs(spark, sf):
    return X.obs(spark, sf).select(
        F.col("ParameterName").alias("param"), F.col("ActivityType").alias("activity"),
        F.col("Habitat").alias("depth"), "ResultValue",
    )


@query("o07_rule_based_inputs", OBS + f"""
SELECT param, activity, depth, count(*) AS n
FROM obs JOIN {_RULES} ON ParameterName = param AND ActivityType = activity AND Habitat = depth GROUP BY ALL""")
def rule_based_inputs(spark, sf):
    rules = dimension(spark, RULES, columns("param", "activity", "depth"))
    rows = readers.select_inputs(_inputs(spark, sf), rules)
    return rows.groupBy("param", "activity", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("o07_partitioned_inputs", OBS + f"""
SELECT param, activity, depth, count(*) AS n
FROM obs JOIN {_RULES} ON ParameterName = param AND ActivityType = activity AND Habitat = depth GROUP BY ALL""")
def partitioned_inputs(spark, sf):
    """Inputs in folders by parameter, activity and depth: those without a rule are not opened."""
    root = scratch_path(spark, "inputs")
    rules = dimension(spark, RULES, columns("param", "activity", "depth"))
    keys = ["param", "activity", "depth"]
    tables.write_tables({"inputs": _inputs(spark, sf), "rules": rules}, root, partition_by={"inputs": keys})
    rows = readers.select_inputs(tables.load_table(spark, root, "inputs"), tables.load_table(spark, root, "rules"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _by_turns(values: list[str], column: str) -> str:
    """Values of the fixed tables, which those of a column stand for by turns."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {column} % {len(values)} {cases} END"


_RULED = [r[0] for r in INPUT_RULES]
_RULE_VALUES = "(VALUES " + ", ".join(map(str, INPUT_RULES)) + ") r(param, activity, depth)"
_RULE_INPUT = f"""SELECT {_by_turns(_RULED, 'LocationID')} AS param, {_by_turns(['Lab', 'Field', 'All'], 'ProgramLocationID')} AS activity,
       {_by_turns(['All', 'Surface'], 'Year')} AS depth, ResultValue FROM obs"""


@query("o14_fixed_input_rules", OBS + f""", inputs AS ({_RULE_INPUT})
SELECT param, activity, depth, count(*) AS n, CAST(sum(ResultValue) AS BIGINT) AS total
FROM inputs JOIN {_RULE_VALUES} USING (param, activity, depth) GROUP BY ALL""")
def fixed_input_rules(spark, sf):
    inputs = spark.sql(_RULE_INPUT.replace("FROM obs", "FROM {obs}"), obs=X.obs(spark, sf))
    rows = readers.select_inputs(inputs, input_rules(spark))
    return rows.groupBy("param", "activity", "depth").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ResultValue").cast("bigint").alias("total")
    )


_UNIT_VALUES = "(VALUES " + ", ".join(map(str, PARAMETER_UNITS)) + ") u(ParameterName, unit)"
_MEASURED = f"SELECT {_by_turns([*[u[0] for u in PARAMETER_UNITS], 'Chlorophyll a'], 'LocationID')} AS ParameterName, ResultValue FROM obs"


@query("o14_fixed_units", OBS + f""", measured AS ({_MEASURED})
SELECT ParameterName, unit, CASE WHEN ParameterName = 'pH' THEN 'pH' ELSE ParameterName || ' (' || unit || ')' END AS axis, count(*) AS n
FROM measured LEFT JOIN {_UNIT_VALUES} USING (ParameterName) GROUP BY ALL""")
def fixed_units(spark, sf):
    rows = spark.sql(_MEASURED.replace("FROM obs", "FROM {obs}"), obs=X.obs(spark, sf))
    rows = lookup(rows.groupBy("ParameterName").agg(F.count(F.lit(1)).alias("n")), parameter_units(spark), ["ParameterName"], ["unit"])
    axis = F.when(F.col("ParameterName") == "pH", F.lit("pH")).otherwise(F.concat("ParameterName", F.lit(" ("), "unit", F.lit(")")))
    return rows.select("ParameterName", "unit", axis.alias("axis"), "n")


_PLOT_VALUES = "(VALUES " + ", ".join(map(str, PLOTS)) + ") p(plot_type, title, alt, label, habitat)"


@query("o14_fixed_plots", OBS + f""", named AS (
  SELECT CASE Habitat WHEN 'Oyster/Oyster Reef' THEN 'Oyster Reef' WHEN 'Water Column' THEN 'Nekton' ELSE Habitat END AS habitat, ManagedAreaName
  FROM obs WHERE ManagedAreaName IS NOT NULL)
SELECT habitat, ManagedAreaName, plot_type, title || ManagedAreaName AS title, alt, label, count(*) AS n
FROM named JOIN {_PLOT_VALUES} USING (habitat) GROUP BY ALL""")
def fixed_plots(spark, sf):
    rows = X.obs(spark, sf).where(F.col("ManagedAreaName").isNotNull())
    rows = rows.groupBy(habitat_name(F.col("Habitat")).alias("habitat"), "ManagedAreaName").agg(F.count(F.lit(1)).alias("n"))
    out = null_safe_join(rows, plots(spark), ["habitat"])
    title = F.concat("title", "ManagedAreaName").alias("title")
    return out.select("habitat", "ManagedAreaName", "plot_type", title, "alt", "label", "n")


def _station_store(spark, sf):
    """Partials of three exports, one of them replaced."""
    obs = X.obs(spark, sf)
    schema_ = partials.station_partials(obs).schema
    store = partials.PartialStore(spark, scratch_path(spark, "partials"), schema_, ("Parameter", "Region"))
    part = lambda k: F.col("LocationID") % 3 == k
    store.put("export_0", partials.station_partials(obs.where(part(0))))
    store.put("export_1", partials.station_partials(obs.where(part(1) & (F.col("Year") < 1998))))
    store.put("export_2", partials.station_partials(obs.where(part(2) & (F.col("Region") != "ASIA"))))
    store.put("export_1", partials.station_partials(obs.where(part(1))))
    return store


@query("o22_partials_by_export", OBS + """
SELECT ProgramLocationID, Year, ParameterName AS Parameter, Region, count(*) AS Data_N FROM obs
WHERE NOT (LocationID % 3 = 2 AND Region = 'ASIA') GROUP BY ALL""")
def partials_by_export(spark, sf):
    """Station-years from the partials of each export, the newest of every one."""
    years = partials.station_years(_station_store(spark, sf).read())
    return years.select("ProgramLocationID", "Year", "Parameter", "Region", "Data_N").distinct()


@query("o09_last_partials_win", OBS + """
SELECT ParameterName AS Parameter, Region, count(*) AS Data_N FROM obs
WHERE LocationID % 3 = CASE WHEN Region = 'ASIA' THEN 1 ELSE 2 END GROUP BY ALL""")
def last_partials_win(spark, sf):
    """Each parameter and region from the export that sorts last; decided before a row is read."""
    rows = _station_store(spark, sf).read("last")
    return rows.groupBy("Parameter", "Region").agg(F.sum("n").alias("Data_N"))


@query("o08_data_inputs", OBS + f"""
SELECT ParameterName AS param, ActivityType AS activity, Habitat AS depth, count(*) AS n
FROM obs WHERE ParameterName IN (SELECT param FROM {_RULES}) GROUP BY ALL""")
def data_inputs(spark, sf):
    rules = dimension(spark, RULES, columns("param", "activity", "depth"))
    rows = readers.select_inputs(_inputs(spark, sf), rules, filetype="data")
    return rows.groupBy("param", "activity", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("o10_dimension_with_preamble", """
SELECT n_nationkey AS ID, n_name AS Name, nullif(r_name, 'ASIA') AS "Group"
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def dimension_with_preamble(spark, sf):
    n, r = X.table(spark, sf, "nation"), X.table(spark, sf, "region")
    line = F.concat_ws(
        "|", F.col("n_nationkey").cast("string"), "n_name", F.coalesce(F.nullif("r_name", F.lit("ASIA")), F.lit(""))
    )
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("n_nationkey") % 4).alias("part"), line.alias("line"))
    # Several files, each with its own preamble and header.
    body = rows.groupBy("part").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("body"))
    files = body.select("part", F.concat_ws("\n", F.lit("Program groups, revised"), F.lit("ID|Name|Group"), "body").alias("value"))
    path = scratch_path(spark, "dimension")
    files.write.partitionBy("part").text(path)
    return read_dimension(spark, path, schema("ID int, Name string, Group string"), skip_rows=1)


@query("o11_point_table", X.with_(X.LOCATION_POINTS) + """
SELECT ProgramLoc, ProgramID, LocationID, round(lat, 5) AS lat, round(lon, 5) AS lon FROM location_points""")
def point_table(spark, sf):
    rows = X.location_points(spark, sf).withColumn("geometry", F.lit("POINT"))
    path = export(spark, rows, "points", "|")
    spec = "ProgramLoc bigint, ProgramID int, LocationID bigint, lat double, lon double"
    out = readers.read_delim(spark, path, schema(spec), null=None)
    return out.withColumns({"lat": F.round("lat", 5), "lon": F.round("lon", 5)})


@query("o12_materialised_table", X.with_(X.OBS, X.SY) + f"""
SELECT ProgramLocationID, Year, Parameter, Region, ManagedAreaName, Data_N, DATE '{X.AS_OF}' AS publish_date FROM sy""")
def materialised_table(spark, sf):
    root = scratch_path(spark, "tables")
    sy = X.station_years(spark, sf).select("ProgramLocationID", "Year", "Parameter", "Region", "ManagedAreaName", "Data_N")
    tables.write_tables({"station_year": sy}, root, X.AS_OF)
    return tables.load_table(spark, root, "station_year")


@query("o12_republished_table", X.with_(X.OBS, X.SY) + """
SELECT ProgramLocationID, Year, Parameter, Region, ManagedAreaName, Data_N FROM sy""")
def republished_table(spark, sf):
    """A table that its own earlier version completes."""
    root = scratch_path(spark, "tables")
    sy = X.station_years(spark, sf).select("ProgramLocationID", "Year", "Parameter", "Region", "ManagedAreaName", "Data_N")
    tables.write_tables({"station_year": sy.where("Year < 1997")}, root)
    earlier = tables.load_table(spark, root, "station_year")
    tables.write_tables({"station_year": earlier.unionByName(sy.where("Year >= 1997"))}, root, cluster_by={"station_year": ["ProgramLocationID"]})
    return tables.load_table(spark, root, "station_year")


@query("o13_loaded_view", X.with_(X.OBS, X.SY) + """
SELECT Region, Parameter, CAST(sum(Data_N) AS BIGINT) AS Data_N FROM sy GROUP BY ALL""")
def loaded_view(spark, sf):
    root = scratch_path(spark, "tables")
    tables.write_tables({"station_year_view": X.station_years(spark, sf)}, root, partition_by={"station_year_view": ["Region"]})
    tables.load_table(spark, root, "station_year_view", view=True)
    return spark.sql(
        "SELECT Region, Parameter, sum(Data_N) AS Data_N FROM station_year_view GROUP BY ALL"
    )


@query("o15_publish_date", f"""
SELECT o_orderpriority, count(*) AS n, DATE '{X.AS_OF}' AS publish_date FROM orders GROUP BY ALL""")
def publish_date(spark, sf):
    counts = X.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return tables.stamped(counts, X.AS_OF)
