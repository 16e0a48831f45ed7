"""Batch pipelines end to end on a small station table, views, and physical plans."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from catalog import fixtures as X
from tidewater.operators import rollups, segments
from tidewater.plans import continuous, habitat, views

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def batch(spark):
    sy = continuous.station_years(X.obs(spark, SF_DIR))
    pins = X.table(spark, SF_DIR, "supplier").where("s_suppkey = 1").select(
        F.col("s_suppkey").alias("ProgramLocationID"), F.lit(2023).alias("endYear"), F.lit("Active").alias("Status")
    )
    return continuous.continuous_tables(
        sy, X.dim_entity(spark, SF_DIR), X.trend_rows(spark, SF_DIR), X.AS_OF, X.LINK, pins, X.HIGHLIGHTS
    )


def test_continuous_tables(batch):
    assert set(batch) == {"entity_segments", "station_segments", "station_markers", "entity_table", "station_table"}
    pinned = batch["station_segments"].where("ProgramLocationID = 1")
    assert {tuple(r) for r in pinned.select("endYear", "Status").collect()} == {(2023, "Active")}
    marker = batch["station_markers"].first()
    assert marker["popup"].startswith("<br> <b>ProgLocID</b>: ") and marker["label"] == str(marker["ProgramLocationID"])
    counted = batch["entity_table"].agg(F.sum("Data_N")).first()[0]
    assert counted == 6000


def test_station_views(batch, spark):
    table = batch["station_table"]
    entity = table.first()["Entity"]
    rows = views.station_parameters(table, entity)
    assert rows.columns == ["ProgramName", "ProgramLocationID", "Data_N", "Status", "Parameter", "SufficientData"]
    assert views.station_parameters(table, entity, []).count() == 0
    station = rows.first()["ProgramLocationID"]
    listed = {r[0] for r in views.parameter_list(table, entity, station).collect()}
    assert listed == {r["Parameter"] for r in rows.collect() if r["ProgramLocationID"] == station and r["SufficientData"]}
    assert views.overview(batch["entity_table"], None, "All", []).count() == 0
    joined = views.overview(None, table, entity).first()["Parameters (Number of Years)"].split(", ")
    assert joined == sorted(set(joined))


def test_coverage_views(batch):
    seg, by_station = batch["entity_segments"], batch["station_segments"]
    assert views.coverage(seg, by_station, "All", statuses=[]).count() == seg.count()
    active = views.coverage(seg, by_station, "All", statuses=["Active"])
    assert 0 < active.count() <= seg.count() and {r[0] for r in active.select("Status").collect()} == {"Active"}
    entity = by_station.first()["Entity"]
    assert views.coverage(seg, by_station, "Entity", entity, []).count() == 0


def test_habitat_tables(spark):
    df = X.habitat_input(spark, SF_DIR)
    pts = X.location_points(spark, SF_DIR)
    tables = habitat.habitat_tables(X.habitat_cells(spark, SF_DIR), pts, X.AS_OF, X.LINK)
    n = df.count()
    rows = lambda t: sorted(map(str, t.collect()))
    for kind in ("all", "program", "area"):
        assert rows(tables[f"summary_{kind}"]) == rows(habitat.summary(df, kind))
    for kind in ("program", "area"):
        assert rows(tables[f"coverage_{kind}"]) == rows(habitat.coverage(df, kind))
    assert rows(tables["location_map"]) == rows(habitat.location_map(df, pts))
    assert tables["summary_all"].agg(F.sum("N_samples")).first()[0] == n
    assert tables["coverage_program"].agg(F.sum("Number of Observations")).first()[0] == n
    assert views.summary_table(tables, "Oyster Reef", "All", "area").columns == ["ParameterName", "Units", "N_samples", "mean", "min", "max"]
    program = tables["coverage_program"].first()["ProgramName"]
    one = views.coverage_table(tables, "Oyster Reef", program, "program")
    whole = tables["coverage_program"].where((F.col("ProgramName") == program) & (F.col("Habitat") == "Oyster/Oyster Reef"))
    assert one.count() == whole.count()
    assert {r[0] for r in views.habitat_choices(tables, "Nekton", "area").collect()} <= {"AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"}


def test_habitat_views_take_display_names(spark):
    seg = spark.createDataFrame([("Water Column", 1, 2000, 2001, "Active")], "Habitat string, ProgramID int, startYear int, endYear int, Status string")
    assert [tuple(r) for r in views.program_years(seg, "Nekton").collect()] == [(1, 1999.9, 2001.1, "Active")]


def test_trend_plot(spark):
    stats = spark.createDataFrame(
        [("s", "DO", "m2", 2000, 9.0, 9.0, True), ("s", "DO", "m1", 2000, 1.0, 0.0, True), ("s", "pH", "m3", 2000, 1.0, 0.0, False)],
        "ProgramLocationID string, ParameterName string, MonitoringID string, EarliestYear int, SennSlope double, "
        "SennIntercept double, SufficientData boolean",
    ).withColumns({"EarliestSampleDate": F.lit("2000-01-01").cast("date"), "LastSampleDate": F.lit("2001-01-01").cast("date")})
    monthly = spark.createDataFrame(
        [("s", p, 2000, 2000.0 + m / 12, float(m)) for p in ("DO", "pH") for m in range(12)],
        "ProgramLocationID string, ParameterName string, Year int, YearMonthDec double, Mean double",
    )
    units = spark.createDataFrame([("DO", "mg/L"), ("pH", "pH")], "ParameterName string, unit string")
    plot = views.trend_plot(stats, monthly, units, "s", "DO")
    assert [(r["MonitoringID"], r["x"], r["y"]) for r in plot["line"].collect()] == [("m1", 2000.0, 0.0), ("m1", 2001.0, 1.0)]
    assert [r["Mean"] for r in plot["points"].collect()] == [float(m) for m in range(12)]
    assert plot["axes"].first()["y_label"] == "DO (mg/L)"
    assert all(df.count() == 0 for df in views.trend_plot(stats, monthly, units, "s", "pH").values())


# Physical plans.


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_gate_and_columns_reach_the_scan(spark):
    text = plan(entry_module.queries()["o17_quality_gate"](spark, SF_DIR))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "lineitem" in line)
    assert "(l_linestatus" in scan and "= F)" in scan and "l_extendedprice" not in scan


def test_segments_use_one_exchange_per_grain(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), (1990 + F.col("id") % 20).cast("int").alias("Year"))
    for mode in ("reference", "islands"):
        text = plan(segments.year_segments(df, ["g"], mode=mode))
        assert text.count("Exchange hashpartitioning(g") == 2  # distinct (g, Year), then g


@pytest.mark.parametrize("kept", ["all", "pruned", "attribute", "year", "map", "map_pruned"])
def test_observations_are_scanned_once(spark, kept):
    """Whatever columns and filters the consumer of a station-year table or station map has."""
    sy = rollups.station_year(X.obs(spark, SF_DIR), ["LocationID", "Year"], ["ProgramID"])
    df = {
        "all": lambda: sy,
        "pruned": lambda: sy.drop("Data_N"),
        "attribute": lambda: sy.where("ProgramID > 3"),
        "year": lambda: sy.where("Year > 1996"),
        "map": lambda: rollups.station_map(X.entity_years(spark, SF_DIR)),
        "map_pruned": lambda: rollups.station_map(X.entity_years(spark, SF_DIR)).drop("Data_N", "rad"),
    }[kept]()
    text = executed(df).split("== Initial Plan ==")[0]
    assert text.count("lineitem.parquet") == 1


def test_units_are_joined_to_cells(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(X.habitat_cells(spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The units' join is the topmost one; below it the cells' aggregate, below that the raw rows.
    assert text.index("SortMergeJoin [coalesce(ParameterName") < text.index("HashAggregate") < text.index("lineitem.parquet")


def test_cells_give_what_rows_give(spark):
    rows = lambda t: sorted(map(str, t.collect()))
    cells, raw = X.habitat_cells(spark, SF_DIR), X.habitat_input(spark, SF_DIR)
    assert cells.agg(F.sum("n_rows")).first()[0] == raw.count()
    assert rows(habitat.summary(cells, "program", cells=True)) == rows(habitat.summary(raw, "program"))


def test_fixtures_can_fail(spark):
    """Several habitats, sites in two of them, both statuses, gaps, and cells fewer than rows."""
    raw, cells = X.habitat_input(spark, SF_DIR), X.habitat_cells(spark, SF_DIR)
    assert raw.select("Habitat").distinct().count() == 3
    twice = raw.groupBy("ProgramLocationID").agg(F.count_distinct("Habitat").alias("n")).where("n = 2")
    assert not twice.isEmpty() and cells.count() * 2 < raw.count()
    seen = X.entity_presence(spark, SF_DIR)
    for table in (continuous.entity_segments(seen, X.AS_OF), continuous.station_segments(seen, X.AS_OF),
                  habitat.program_segments(cells, X.AS_OF), continuous.entity_table(X.entity_years(spark, SF_DIR), X.AS_OF)):
        assert {r[0] for r in table.select("Status").distinct().collect()} == {"Active", "Historical"}
    gaps = habitat.program_segments(cells, X.AS_OF).groupBy("Habitat", "ProgramID").count().where("count > 1")
    assert not gaps.isEmpty()


def test_site_in_two_habitats_has_two_markers(spark):
    marks = habitat.location_map(X.habitat_cells(spark, SF_DIR), X.location_points(spark, SF_DIR), "n_rows")
    two = marks.groupBy("ProgramLocationID", "LocationID").agg(F.collect_set("habitat_name").alias("h")).where("size(h) = 2")
    assert {"Oyster Reef", "Submerged Aquatic Vegetation"} == set(two.first()["h"])
    assert views.programs_per_habitat(marks).count() == 3


def test_first_row_is_limited_before_the_shuffle(spark):
    text = plan(segments.first_per(X.trend_rows(spark, SF_DIR), ["ProgramLocationID"], ["MonitoringID"]))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_small_dimensions_are_broadcast_by_size(spark):
    q = entry_module.queries()["o14_units_per_parameter"]
    assert "BroadcastHashJoin" in plan(q(spark, SF_DIR))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(q(spark, SF_DIR))
        assert "Broadcast" not in text and "SortMergeJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batch_runs(spark, tmp_path):
    from tidewater.plans import batch as runs
    from tidewater.sources.tables import load_table

    obs = X.obs(spark, SF_DIR)
    stats, monthly = X.trend_rows(spark, SF_DIR), X.monthly(spark, SF_DIR)
    sites = obs.withColumnRenamed("Habitat", "habitat")
    one = F.col("ProgramLocationID") == 3
    earlier = runs.Archive([3], obs.where(one), stats.where(one), monthly)
    root = str(tmp_path / "c")
    done = runs.run_continuous(
        spark, obs.where(~one), X.dim_entity(spark, SF_DIR), stats.where(~one), monthly.where(~one), sites,
        X.points(spark, SF_DIR), root, X.AS_OF, X.LINK, highlights=X.HIGHLIGHTS, archive=earlier,
    )
    assert len(done) == 9
    # The archived station is back in every table, each of which reads back.
    read = {name: load_table(spark, root, name) for name in done}
    assert read["entity_table"].agg(F.sum("Data_N")).first()[0] == 6000
    assert read["trend_rows"].count() == stats.count() and read["monthly_means"].count() == monthly.count()
    for name in ("station_years", "station_segments", "station_markers", "station_table", "trend_rows", "monthly_means"):
        assert not read[name].where(one).isEmpty()
    assert read["site_points"].select("habitat").distinct().count() == 3 and not read["entity_segments"].isEmpty()
    done = runs.run_habitat(
        spark, obs, X.thresholds(spark, SF_DIR), X.location_points(spark, SF_DIR), str(tmp_path / "h"), X.AS_OF, X.LINK,
        X.FLAGS, ["SMALL"],
    )
    assert len(done) == 11
    total = X.habitat_input(spark, SF_DIR).count()
    root = str(tmp_path / "h")
    assert views.programs_per_habitat(load_table(spark, root, "location_map")).count() >= 2
    assert all(not load_table(spark, root, name).isEmpty() for name in done)
    assert load_table(spark, root, "summary_program").agg(F.sum("N_samples")).first()[0] == total


def test_trend_run(spark, tmp_path):
    from tidewater.operators import trends
    from tidewater.plans import batch as runs
    from tidewater.sources.tables import load_table

    areas = spark.createDataFrame([(1, "NATION_1", "NA1"), (2, "NATION_2", "NA2")], "AreaID int, ManagedAreaName string, Abbreviation string")
    files = spark.createDataFrame([("f/NA1_multiplot.png",), ("f/Coral_pc_NATION_2.png",)], "path string")
    species = X.trend_rows(spark, SF_DIR).withColumnsRenamed({
        "ProgramLocationID": "ManagedAreaName", "ParameterName": "Species", "MonitoringID": "StatisticalTrend",
        "SennIntercept": "LME_Intercept", "SennSlope": "LME_Slope",
    })
    stats = X.trend_rows(spark, SF_DIR)
    done = runs.run_trends(
        spark, {"disc": stats, "cont": stats}, species, X.intervals(spark, SF_DIR), areas, files, str(tmp_path), X.AS_OF
    )
    assert set(done) == {"trend_disc", "trend_cont", "species_trends", "interval_trends", "area_figures", "plots"}
    found = load_table(spark, str(tmp_path), "area_figures").select("AreaID", "multiplot", "Coral_pc", "trendplot").collect()
    assert sorted(map(tuple, found)) == [
        (1, "f/NA1_multiplot.png", "FALSE", "FALSE"), (2, "FALSE", "f/Coral_pc_NATION_2.png", "FALSE"),
    ]
    trend = load_table(spark, str(tmp_path), "trend_cont")
    assert trend.count() == trends.trend_class(stats).count()


def test_initial_partitions():
    from tidewater.session import initial_partitions

    assert initial_partitions(0) == 200
    assert initial_partitions(10 * 2**40) == 81920
