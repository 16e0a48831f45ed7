"""Gates, fills, overrides, joins, unions and figure matching."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog import query
from tidewater.functions.semantics import null_safe_join
from tidewater.operators import clean, figures, joins, rollups
from tidewater.plans import continuous, habitat
from tidewater.sources.dimensions import columns, dimension

OBS = X.with_(X.OBS)
ENTITY = X.with_(*X.ENTITY_CTES)


@query("o14_units_per_parameter", OBS + """
SELECT Habitat, o.ParameterName, u.unit, count(*) AS n
FROM obs o LEFT JOIN (VALUES ('LARGE', 'mg/L'), ('SMALL', '%'), ('PROMO', 'pH')) u(ParameterName, unit) USING (ParameterName)
GROUP BY ALL""")
def units_per_parameter(spark, sf):
    units = dimension(spark, [("LARGE", "mg/L"), ("SMALL", "%"), ("PROMO", "pH")], columns("ParameterName", "unit"))
    counts = X.obs(spark, sf).groupBy("Habitat", "ParameterName").agg(F.count(F.lit(1)).alias("n"))
    return joins.lookup(counts, units, ["ParameterName"], ["unit"]).select("Habitat", "ParameterName", "unit", "n")


@query("o14_habitat_codes", OBS + """
SELECT code, t.habitat, count(ProgramLocationID) AS n FROM (VALUES ('sav', 'Submerged Aquatic Vegetation'), ('oyster', 'Oyster Reef'),
  ('coral', 'Coral Reef'), ('cw', 'Coastal Wetlands'), ('nekton', 'Nekton')) t(code, habitat)
LEFT JOIN obs ON t.habitat = CASE obs.Habitat WHEN 'Water Column' THEN 'Nekton' WHEN 'Oyster/Oyster Reef' THEN 'Oyster Reef' ELSE obs.Habitat END
GROUP BY ALL""")
def habitat_codes(spark, sf):
    """The fixed habitat table beside the observations of each habitat."""
    from tidewater.sources.dimensions import habitats

    rows = X.obs(spark, sf).select(joins.habitat_name(F.col("Habitat")).alias("habitat"))
    counts = rows.groupBy("habitat").agg(F.count(F.lit(1)).alias("n"))
    return joins.lookup(habitats(spark), counts, ["habitat"], ["n"]).fillna(0, ["n"])


@query("o16_renamed_view", OBS + """
SELECT ProgramName AS "Program Name", ProgramLocationID AS "Station ID", ParameterName AS "Parameter", Year, 'obs' AS tag
FROM obs""")
def renamed_view(spark, sf):
    out = clean.view(X.obs(spark, sf), {
        "ProgramName": "Program Name", "ProgramLocationID": "Station ID", "ParameterName": "Parameter", "Year": "Year",
    })
    return out.withColumn("tag", F.lit("obs"))


@query("o17_quality_gate", OBS + """
SELECT ProgramID, count(*) AS n, CAST(sum(ResultValue) AS BIGINT) AS total
FROM obs WHERE Include = 'F' AND MADup = 1 GROUP BY ALL""")
def quality_gate(spark, sf):
    rows = clean.quality_gate(X.obs(spark, sf), X.FLAGS)
    return rows.groupBy("ProgramID").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ResultValue").cast("bigint").alias("total")
    )


@query("o18_keep_and_exclude", OBS + """
SELECT ParameterName, ManagedAreaName, count(*) AS n FROM obs
WHERE ParameterName IN ('LARGE', 'SMALL', 'PROMO')
  AND (ManagedAreaName IS NULL OR ManagedAreaName NOT IN ('EUROPE', 'AFRICA')) GROUP BY ALL""")
def keep_and_exclude(spark, sf):
    rows = clean.keep(X.obs(spark, sf), "ParameterName", ["LARGE", "SMALL", "PROMO"])
    rows = clean.exclude(rows, "ManagedAreaName", ["EUROPE", "AFRICA"])
    return rows.groupBy("ParameterName", "ManagedAreaName").agg(F.count(F.lit(1)).alias("n"))


@query("o19_conditional_overwrite", OBS + """
SELECT coalesce(ManagedAreaName, ProgramName) AS ManagedAreaName,
       CASE WHEN SparseValue > 0.05 THEN 'high' ELSE ActivityType END AS ActivityType, count(*) AS n
FROM obs GROUP BY ALL""")
def conditional_overwrite(spark, sf):
    rows = clean.fill(X.obs(spark, sf), "ManagedAreaName", "ProgramName")
    rows = clean.overwrite(rows, "ActivityType", F.col("SparseValue") > 0.05, F.lit("high"))
    return rows.groupBy("ManagedAreaName", "ActivityType").agg(F.count(F.lit(1)).alias("n"))


@query("o20_overrides", X.with_(*X.ENTITY_CTES, X.segment_ctes("seg", "ey", "Entity, ProgramLocationID, ProgramName")) + f""",
pinned AS (SELECT DISTINCT ProgramLoc FROM (SELECT s_suppkey AS ProgramLoc FROM supplier WHERE s_acctbal < 0))
SELECT Entity, ProgramLocationID, ProgramName, startYear,
       CASE WHEN ProgramLoc IS NOT NULL THEN 2023 ELSE endYear END AS endYear,
       CASE WHEN ProgramLoc IS NOT NULL THEN 'Active' ELSE {X.status_sql('endYear')} END AS Status
FROM seg LEFT JOIN pinned ON ProgramLocationID = ProgramLoc""")
def overrides(spark, sf):
    pinned = X.table(spark, sf, "supplier").where("s_acctbal < 0").select(
        F.col("s_suppkey").alias("ProgramLocationID"), F.lit(2023).alias("endYear"), F.lit("Active").alias("Status")
    )
    rows = continuous.station_segments(X.entity_presence(spark, sf), X.AS_OF)
    return clean.apply_overrides(rows, pinned, ["ProgramLocationID"])


@query("o51_attach_entity", ENTITY + """
SELECT Entity, link, link2, ProgramLocationID, Year, Parameter, Data_N FROM ey""")
def attach_entity(spark, sf):
    return X.entity_years(spark, sf).select(
        "Entity", "link", "link2", "ProgramLocationID", "Year", "Parameter", "Data_N"
    )


@query("o53_sites_with_points", X.with_(X.OBS, X.POINTS) + """,
sites AS (SELECT Habitat AS habitat, ProgramID, ProgramLocationID, count(*) AS N_Data FROM obs GROUP BY ALL)
SELECT s.habitat, p.ProgramLoc, p.ProgramID, round(p.lat, 5) AS lat, round(p.lon, 5) AS lon,
       '<br> <b>' || s.habitat || '</b><br> ProgramLocationID: ' || p.ProgramLoc || '<br> ProgramID: ' || p.ProgramID AS popup
FROM points p JOIN sites s ON p.ProgramLoc = s.ProgramLocationID AND p.ProgramID = s.ProgramID""")
def sites_with_points(spark, sf):
    rows = X.obs(spark, sf).withColumnRenamed("Habitat", "habitat")
    out = continuous.habitat_points(rollups.site_counts(rows), X.points(spark, sf))
    return out.withColumns({"lat": F.round("lat", 5), "lon": F.round("lon", 5)})


@query("o54_location_map", X.with_(*X.HABITAT_CTES, X.LOCATION_POINTS) + f""", m AS (
  SELECT Habitat, ProgramLocationID, ProgramID, ProgramName, LocationID, count(*) AS n_data,
         array_to_string(list_sort(list(DISTINCT Year)), ', ') AS years,
         array_to_string(list_sort(list(DISTINCT ParameterName)), ', ') AS params FROM hab GROUP BY ALL)
SELECT m.*, {X.HABITAT_NAME} AS habitat_name, round(p.lat, 5) AS lat, round(p.lon, 5) AS lon, round(sqrt(n_data) / 8, 6) AS rad,
       m.ProgramID || ': ' || ProgramName || ' - LocID: ' || m.LocationID AS label,
       concat_ws(' ', 'ProgramID: ', m.ProgramID, '<br> ProgramName: ', ProgramName, '<br> LocID: ', m.LocationID,
                 '<br> ProgLocID: ', ProgramLocationID, '<br> N_Data: ', n_data, '<br> Years: ', years,
                 '<br> params: ', params) AS popup
FROM m JOIN location_points p ON m.ProgramLocationID = p.ProgramLoc AND m.ProgramID = p.ProgramID AND m.LocationID = p.LocationID""")
def location_map(spark, sf):
    from tidewater.functions.text import list_text

    out = habitat.location_map(X.habitat_cells(spark, sf), X.location_points(spark, sf), "n_rows")
    return out.withColumns({
        "lat": F.round("lat", 5), "lon": F.round("lon", 5), "rad": F.round("rad", 6),
        "years": list_text(F.col("years")), "params": list_text(F.col("params")),
    })


@query("o55_attach_units", X.with_(X.OBS, X.THRESHOLDS) + """
SELECT ParameterName, Habitat, Units, count(*) AS n FROM obs JOIN thresholds USING (ParameterName, Habitat) GROUP BY ALL""")
def attach_units(spark, sf):
    rows = joins.attach_units(X.obs(spark, sf), X.thresholds(spark, sf))
    return rows.groupBy("ParameterName", "Habitat", "Units").agg(F.count(F.lit(1)).alias("n"))


@query("o56_threshold_habitat", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'Water Column' WHEN 'fr' THEN 'Oyster/Oyster Reef'
                         WHEN 'de' THEN 'Coral/Coral Reef' ELSE 'Coastal Wetlands' END AS habitat FROM documents""")
def threshold_habitat(spark, sf):
    lang = F.col("lang")
    name = (
        F.when(lang == "en", "Nekton").when(lang == "fr", "Oyster Reef").when(lang == "de", "Coral Reef")
        .otherwise("Coastal Wetlands")
    )
    return X.table(spark, sf, "documents").select("doc_id", joins.threshold_habitat(name).alias("habitat"))


@query("o57_known_points", X.with_(X.OBS, X.POINTS) + """
SELECT ProgramLoc, ProgramID, round(lat, 5) AS lat FROM points p
WHERE EXISTS (SELECT 1 FROM obs WHERE ProgramLocationID = p.ProgramLoc)""")
def known_points(spark, sf):
    """Every other point is of a station that no observation has."""
    both = X.points(spark, sf).withColumn("ProgramLoc", F.explode(F.array("ProgramLoc", -F.col("ProgramLoc") - 1)))
    out = joins.known_only(both, X.obs(spark, sf), [("ProgramLoc", "ProgramLocationID")])
    return out.select("ProgramLoc", "ProgramID", F.round("lat", 5).alias("lat"))


@query("o57_region_markers", X.with_(X.OBS) + """
SELECT ManagedAreaName, ProgramID, count(*) AS n FROM obs
WHERE ManagedAreaName IN (SELECT r_name FROM region WHERE r_name LIKE 'A%') GROUP BY ALL""")
def region_markers(spark, sf):
    from tidewater.plans.views import region_markers as view

    areas = X.table(spark, sf, "region").select(
        F.col("r_name").alias("ManagedAreaName"), F.substring("r_name", 1, 1).alias("Region")
    )
    rows = X.obs(spark, sf).groupBy("ManagedAreaName", "ProgramID").agg(F.count(F.lit(1)).alias("n"))
    return view(rows, areas, "A")


@query("o58_area_lookup", OBS + """
SELECT ManagedAreaName, r_regionkey AS AreaID, count(*) AS n FROM obs LEFT JOIN region ON ManagedAreaName = r_name GROUP BY ALL""")
def area_lookup(spark, sf):
    areas = X.table(spark, sf, "region").select(
        F.col("r_name").alias("ManagedAreaName"), F.col("r_regionkey").alias("AreaID")
    )
    counts = X.obs(spark, sf).groupBy("ManagedAreaName").agg(F.count(F.lit(1)).alias("n"))
    return joins.lookup(counts, areas, ["ManagedAreaName"], ["AreaID"])


# Figure matching: hosts of the crawled pages play managed areas, page addresses play files.
TYPES = ["ref", "html", "utm_source", "feed", "nothing"]
BY_NAME = ["utm_source", "html"]
_HOST = "regexp_extract(url, '//([^/]+)/', 1)"
_LABEL = "regexp_extract(url, '//(?:www[.]|blog[.]|m[.])?([^./]+)[.]', 1)"


def page_areas(spark, sf):
    url = F.col("url")
    host = F.regexp_extract(url, "//([^/]+)/", 1)
    label = F.regexp_extract(url, "//(?:www[.]|blog[.]|m[.])?([^./]+)[.]", 1)
    return X.table(spark, sf, "pages").select(
        F.replace(host, F.lit("."), F.lit(" .")).alias("ManagedAreaName"), label.alias("Abbreviation")
    ).distinct()


def page_files(spark, sf):
    return X.table(spark, sf, "pages").select(F.col("url").alias("path"))


_AREAS = f"""areas AS (
  SELECT DISTINCT replace({_HOST}, '.', ' .') AS ManagedAreaName, {_LABEL} AS Abbreviation FROM pages),
targets AS (
  SELECT ManagedAreaName, Abbreviation, t AS plot_type,
         CASE WHEN t IN ('utm_source', 'html') THEN replace(ManagedAreaName, ' ', '') ELSE Abbreviation END AS key
  FROM areas, (SELECT unnest({TYPES}) AS t)),
"""
_PAIRS = _AREAS + """pairs AS (
  SELECT t.*, url AS path,
         CASE WHEN regexp_matches(url, '(?i){b}' || replace(key, '-', '\\-') || '{m}' || plot_type || '{e}') THEN 1
              WHEN regexp_matches(url, '(?i){b}' || plot_type || '{m}' || replace(key, '-', '\\-') || '{e}') THEN 2 END AS k
  FROM targets t, pages),
matches AS (
  SELECT t.ManagedAreaName, t.plot_type, coalesce(p.path, 'FALSE') AS path
  FROM targets t LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY ManagedAreaName, plot_type ORDER BY k, path) AS r FROM pairs WHERE k IS NOT NULL) p
  ON t.ManagedAreaName = p.ManagedAreaName AND t.plot_type = p.plot_type AND p.r = 1)"""
_LOOSE = _PAIRS.format(b="", m=".*", e="")
_TOKEN = _PAIRS.format(b="(^|[^a-z0-9])", m="[^a-z0-9](.*[^a-z0-9])?", e="($|[^a-z0-9])")


@query("o59_figure_match", "WITH " + _LOOSE + " SELECT * FROM matches")
def figure_match(spark, sf):
    return figures.match_figures(page_areas(spark, sf), TYPES, page_files(spark, sf), by_name=BY_NAME)


@query("o59_figure_match_token", "WITH " + _TOKEN + " SELECT * FROM matches")
def figure_match_token(spark, sf):
    return figures.match_figures(page_areas(spark, sf), TYPES, page_files(spark, sf), token=True, by_name=BY_NAME)


@query("o60_figure_key", "WITH " + _AREAS.rstrip(",\n") + " SELECT ManagedAreaName, plot_type, key FROM targets")
def figure_key(spark, sf):
    return figures.figure_targets(page_areas(spark, sf), TYPES, BY_NAME)


@query("o68_available_figures", "WITH " + _LOOSE + " SELECT * FROM matches WHERE path <> 'FALSE'")
def available_figures(spark, sf):
    found = figures.match_figures(page_areas(spark, sf), TYPES, page_files(spark, sf), by_name=BY_NAME)
    return figures.figures_long(figures.figures_wide(found, TYPES), TYPES)


@query("o103_available_plots", "WITH " + _LOOSE + """
SELECT m.ManagedAreaName, 'F' AS habitat, m.plot_type, m.path, upper(m.plot_type) AS label, 'alt' AS alt,
       'Title ' || m.ManagedAreaName AS title, Abbreviation || '__' || m.plot_type AS button_id, true AS has_table
FROM matches m JOIN areas USING (ManagedAreaName) WHERE path <> 'FALSE'""")
def available_plots(spark, sf):
    meta = dimension(
        spark, [(t, "Title ", "alt", t.upper(), "F") for t in TYPES],
        columns("plot_type", "title", "alt", "label", "habitat"),
    )
    areas = page_areas(spark, sf)
    found = figures.match_figures(areas, TYPES, page_files(spark, sf), by_name=BY_NAME)
    return figures.available_plots(areas, figures.figures_wide(found, TYPES), meta, "F")


@query("o61_ordered", OBS + """
SELECT ManagedAreaName, Year, count(*) AS n FROM obs GROUP BY ALL ORDER BY n DESC, ManagedAreaName NULLS LAST, Year""")
def ordered(spark, sf):
    rows = X.obs(spark, sf).groupBy("ManagedAreaName", "Year").agg(F.count(F.lit(1)).alias("n"))
    return clean.ordered(rows, ["-n", "ManagedAreaName", "Year"])


@query("o62_category_rank", ENTITY + """
SELECT Entity, CASE Entity WHEN 'GROUP_ASIA' THEN 1 WHEN 'GROUP_AMERICA' THEN 2 ELSE 3 END AS rank, count(*) AS n
FROM ey GROUP BY ALL""")
def category_rank(spark, sf):
    rows = X.entity_years(spark, sf).groupBy("Entity").agg(F.count(F.lit(1)).alias("n"))
    rows = clean.entity_order(rows, "Entity", X.HIGHLIGHTS)
    return rows.withColumn("rank", clean.category_rank("Entity", X.HIGHLIGHTS))


@query("o63_union_strict", OBS + """
SELECT ProgramID AS id, 'program' AS kind, count(*) AS n FROM obs GROUP BY ALL
UNION ALL SELECT ProgramLocationID, 'station', count(*) FROM obs GROUP BY ALL""")
def union_strict(spark, sf):
    rows = X.obs(spark, sf)
    count = F.count(F.lit(1)).alias("n")
    by_program = rows.groupBy(F.col("ProgramID").cast("bigint").alias("id"), F.lit("program").alias("kind")).agg(count)
    by_station = rows.groupBy(F.col("ProgramLocationID").alias("id"), F.lit("station").alias("kind")).agg(count)
    return clean.union_strict(by_program, by_station)


@query("o64_union_loose", OBS + """
SELECT ParameterName, NULL AS ProgramID, count(*) AS n FROM obs GROUP BY ALL
UNION ALL SELECT ParameterName, ProgramID, count(*) FROM obs GROUP BY ALL""")
def union_loose(spark, sf):
    rows = X.obs(spark, sf)
    count = F.count(F.lit(1)).alias("n")
    return clean.union_loose(
        rows.groupBy("ParameterName").agg(count), rows.groupBy("ParameterName", "ProgramID").agg(count)
    )


@query("o65_backfill", X.with_(X.OBS, X.SY) + """
SELECT ProgramLocationID, Year, Parameter, Data_N, Units FROM sy WHERE Year >= 1998
UNION ALL
SELECT ProgramLocationID, Year, Parameter, Data_N, NULL FROM sy
WHERE Year < 1998 AND ProgramLocationID IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def backfill(spark, sf):
    sy = X.station_years(spark, sf)
    keys = X.table(spark, sf, "supplier").where("s_acctbal < 0").select("s_suppkey")
    cols = ["ProgramLocationID", "Year", "Parameter", "Data_N"]
    current = sy.where("Year >= 1998").select(*cols, "Units")
    return clean.backfill(current, sy.where("Year < 1998").select(*cols), "ProgramLocationID", keys)


@query("o67_record_rows", """
SELECT o_orderpriority AS plot_type, t.label, count(*) AS n FROM orders
LEFT JOIN (VALUES ('1-URGENT', 'first'), ('5-LOW', 'last')) t(plot_type, label) ON o_orderpriority = t.plot_type GROUP BY ALL""")
def record_rows(spark, sf):
    from tidewater.sources.dimensions import records

    rows = records(spark, {"1-URGENT": {"label": "first"}, "5-LOW": {"label": "last"}}, "plot_type")
    counts = X.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("plot_type")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return null_safe_join(counts, rows, ["plot_type"], "left")


@query("o69_unnest_years", X.with_(*X.HABITAT_CTES) + "SELECT DISTINCT Habitat, ProgramLocationID, LocationID, Year FROM hab")
def unnest_years(spark, sf):
    marks = rollups.location_markers(X.habitat_cells(spark, sf), n="n_rows")
    return marks.select("Habitat", "ProgramLocationID", "LocationID", F.explode("years").alias("Year"))
