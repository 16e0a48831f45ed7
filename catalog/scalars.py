"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog import query
from tidewater.functions import dates, text
from tidewater.functions.semantics import round_half_even
from tidewater.operators import rollups
from tidewater.sources.readers import wanted_path

OBS = X.with_(X.OBS)


@query("o72_text_building", OBS + f"""
SELECT DISTINCT ProgramLocationID, '{X.LINK}' || ProgramID AS link, ProgramID || ' - ' || ProgramName AS id_name,
       '<a href=''{X.LINK}' || ProgramID || ''' target=''_blank''>' || ProgramName || '</a>' AS anchor,
       '<a id=''button_' || ParameterName || '_' || ProgramLocationID || ''' href=''#''>' || ParameterName || ' (' || Year || ')</a>' AS button,
       '<br> Area: ' || coalesce(ManagedAreaName, 'NA') || '<br> Year: ' || Year AS popup
FROM obs""")
def text_building(spark, sf):
    link = text.detail_link(X.LINK, "ProgramID")
    parameter, station = F.col("ParameterName"), F.col("ProgramLocationID")
    return X.obs(spark, sf).select(
        "ProgramLocationID",
        link.alias("link"),
        text.id_name("ProgramID", "ProgramName").alias("id_name"),
        text.anchor(link, F.col("ProgramName")).alias("anchor"),
        text.button("button", parameter, station, text.years_label(parameter, F.col("Year"))).alias("button"),
        text.labelled([("Area", F.col("ManagedAreaName")), ("Year", F.col("Year"))]).alias("popup"),
    ).distinct()


@query("o73_linked_name", OBS + """
SELECT DISTINCT ProgramName, CASE WHEN ManagedAreaName IS NOT NULL
  THEN '<a href=''' || ManagedAreaName || ''' target=''_blank''>' || ProgramName || '</a>' ELSE ProgramName END AS name FROM obs""")
def linked_name(spark, sf):
    return X.obs(spark, sf).select(
        "ProgramName", text.linked_name(F.col("ManagedAreaName"), F.col("ProgramName")).alias("name")
    ).distinct()


@query("o74_conditional_button", X.with_(X.TREND_ROWS) + """
SELECT MonitoringID, CASE WHEN SufficientData THEN '<a id=''b_' || ParameterName || '_' || ProgramLocationID || ''' href=''#''>' || ParameterName || ' (' || N_Years || ')</a>'
  ELSE ParameterName || ' (' || N_Years || ')' END AS button FROM trend_rows""")
def conditional_button(spark, sf):
    parameter = F.col("ParameterName")
    label = text.years_label(parameter, F.col("N_Years"))
    clickable = text.button("b", parameter, F.col("ProgramLocationID"), label)
    return X.trend_rows(spark, sf).select(
        "MonitoringID", F.when(F.col("SufficientData"), clickable).otherwise(label).alias("button")
    )


@query("o76_bubble_radius", OBS + """
SELECT ProgramLocationID, round(sqrt(count(*)) / 100, 8) AS map_radius, round(sqrt(count(*)) / 8, 8) AS site_radius
FROM obs GROUP BY ALL""")
def bubble_radius(spark, sf):
    counts = X.obs(spark, sf).groupBy("ProgramLocationID").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "ProgramLocationID",
        F.round(rollups.bubble(F.col("n"), 100), 8).alias("map_radius"),
        F.round(rollups.bubble(F.col("n"), 8), 8).alias("site_radius"),
    )


@query("o77_short_names", """
SELECT p_partkey, replace(replace(p_name, 'small', 'S'), 'widget', 'WDG') AS short FROM part""")
def short_names(spark, sf):
    return X.table(spark, sf, "part").select(
        "p_partkey", text.short_names(F.col("p_name"), [("small", "S"), ("widget", "WDG")]).alias("short")
    )


@query("o78_without_blanks", "SELECT doc_id, replace(text, ' ', '') AS packed FROM documents")
def without_blanks(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", text.without_blanks(F.col("text")).alias("packed"))


@query("o79_split_ids", OBS + """
SELECT DISTINCT ParameterName || '_' || ProgramName AS id, ParameterName AS parameter, ProgramName AS station FROM obs""")
def split_ids(spark, sf):
    # The program name holds the separator itself, the last part must keep it.
    rows = X.obs(spark, sf).select(F.concat_ws("_", "ParameterName", "ProgramName").alias("id")).distinct()
    return rows.select(
        "id", text.id_part(F.col("id"), 0, 2).alias("parameter"), text.id_part(F.col("id"), 1, 2).alias("station")
    )


@query("o05_file_token", """
SELECT page_id, string_split(string_split(url, '/')[-1], '_')[2] AS token FROM pages""")
def file_token(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", text.file_token(F.col("url"), 1).alias("token"))


@query("o80_pattern_filter", """
SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)blog|www') AND NOT regexp_matches(url, 'utm_') AND url LIKE '%html'""")
def pattern_filter(spark, sf):
    ok = wanted_path(F.col("url"), include="(?i)blog|www", exclude=["utm_"], suffix="html")
    return X.table(spark, sf, "pages").where(ok).select("page_id", "url")


@query("o81_cutoff_year", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(year(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR) AS INTEGER) AS cutoff FROM orders""")
def cutoff_year(spark, sf):
    day = F.to_date("o_orderdate")
    return X.table(spark, sf, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), dates.cutoff_year(day).alias("cutoff")
    )


@query("o82_decimal_year", """
SELECT o_orderkey, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / dayofyear(make_date(year(o_orderdate), 12, 31))::DOUBLE, 8) AS x FROM orders""")
def decimal_year(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", F.round(dates.decimal_year("o_orderdate"), 8).alias("x"))


@query("o83_rounding", f"""
SELECT o_orderkey, CAST(round_even(o_orderkey / 2.0, 0) AS INTEGER) AS half_even,
       {X.r_round('o_totalprice / 1000', 2)} AS thousands FROM orders""")
def rounding(spark, sf):
    half = F.col("o_orderkey") / F.lit(2.0)
    return X.table(spark, sf, "orders").select(
        "o_orderkey", F.bround(half, 0).cast("int").alias("half_even"),
        round_half_even(F.col("o_totalprice") / 1000, 2).alias("thousands"),
    )


@query("o84_interval_text", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN nullif(l_discount, 0.0) IS NULL THEN 'NA' ELSE CAST(l_discount AS VARCHAR) END ||
       ' to ' || regexp_replace(CAST(l_quantity AS VARCHAR), '\\.0$', '') AS interval_text FROM lineitem""")
def interval_text(spark, sf):
    lo = F.nullif("l_discount", F.lit(0.0))
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.interval_text(lo, F.col("l_quantity")).alias("interval_text")
    )


@query("o85_period_text", OBS + """
SELECT LocationID, ManagedAreaName, min(Year) || ' - ' || max(Year) AS period,
       coalesce(ManagedAreaName, 'NA') || ' - ' || count(*) AS area_count FROM obs GROUP BY LocationID, ManagedAreaName""")
def period_text(spark, sf):
    rows = X.obs(spark, sf).groupBy("LocationID", "ManagedAreaName").agg(
        F.min("Year").alias("lo"), F.max("Year").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    return rows.select(
        "LocationID", "ManagedAreaName",
        text.period_text(F.col("lo"), F.col("hi")).alias("period"),
        text.period_text(F.col("ManagedAreaName"), F.col("n")).alias("area_count"),
    )


@query("o86_axis_label", OBS + """
SELECT DISTINCT ParameterName, CASE WHEN ParameterName = 'PROMO' THEN ParameterUnits ELSE ParameterName || ' (' || ParameterUnits || ')' END AS label FROM obs""")
def axis_label(spark, sf):
    label = text.axis_label(F.col("ParameterName"), F.col("ParameterUnits"), "PROMO")
    return X.obs(spark, sf).select("ParameterName", label.alias("label")).distinct()


@query("o87_tick_step", OBS + """, s AS (
  SELECT LocationID, CAST(min(Year) AS INTEGER) AS lo, CAST(max(Year) AS INTEGER) AS hi FROM obs GROUP BY LocationID)
SELECT LocationID, step, array_to_string(range(hi, lo - 1, -step), ', ') AS ticks
FROM (SELECT *, CASE WHEN hi - lo >= 30 THEN 10 WHEN hi - lo >= 10 THEN 4 WHEN hi - lo >= 4 THEN 2 ELSE 1 END AS step FROM s)""")
def tick_step(spark, sf):
    rows = rollups.extent(X.obs(spark, sf), "Year", "Year", ["LocationID"])
    lo, hi = F.col("min_value"), F.col("max_value")
    step = dates.tick_step(hi - lo)
    ticks = dates.descending_ticks(hi, lo, step).cast("array<string>")
    return rows.select("LocationID", step.alias("step"), F.concat_ws(", ", ticks).alias("ticks"))


@query("o88_coverage_ticks", OBS + """
SELECT LocationID, array_to_string(range(max(Year), min(Year) - 1, -2), ', ') AS ticks FROM obs GROUP BY LocationID""")
def coverage_ticks(spark, sf):
    rows = rollups.extent(X.obs(spark, sf), "Year", "Year", ["LocationID"])
    ticks = dates.coverage_ticks(F.col("min_value"), F.col("max_value")).cast("array<string>")
    return rows.select("LocationID", F.concat_ws(", ", ticks).alias("ticks"))


@query("o89_array_functions", X.with_(*X.HABITAT_CTES) + """
SELECT Habitat, ProgramLocationID, LocationID, count(DISTINCT Year) AS n_years, bool_or(Year = 2000) AS has_2000,
       count(DISTINCT ParameterName) AS n_params, CAST(min(Year) AS INTEGER) AS first_year FROM hab GROUP BY Habitat, ProgramLocationID, ProgramID, ProgramName, LocationID""")
def array_functions(spark, sf):
    marks = rollups.location_markers(X.habitat_cells(spark, sf), n="n_rows")
    return marks.select(
        "Habitat", "ProgramLocationID", "LocationID",
        F.size("years").cast("bigint").alias("n_years"),
        F.array_contains("years", 2000).alias("has_2000"),
        F.size(F.array_distinct("params")).cast("bigint").alias("n_params"),
        F.col("years")[0].alias("first_year"),
    )
