"""Readers and writers on small files written by the tests."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.sources import constants, dimensions, readers, scratch, tables


def ddl(spec):
    return T.StructType.fromDDL(spec)


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def values(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)


def test_pipe_scan_takes_columns_by_name(spark, tmp_path):
    path = write(tmp_path, "obs.txt", 'extra|Year|Site|Value|Size\nx|2000|a b|1.5|\ny|NULL|NULL|NULL|"q|r"\n')
    df = readers.read_delim(spark, path, ddl("Site string, Year int, Value double, Size string"))
    assert values(df) == [("a b", 2000, 1.5, None), (None, None, None, "q|r")]


def test_default_null_keeps_the_text_null(spark, tmp_path):
    path = write(tmp_path, "stats.txt", "a|ok|d\nNULL|TRUE|2020-02-03\n|FALSE|\n")
    df = readers.read_delim(spark, path, ddl("a string, ok boolean, d date"), null=None)
    assert [(r[0], r[1], str(r[2])) for r in df.collect()] == [("NULL", True, "2020-02-03"), (None, False, "None")]


def test_byte_order_mark_is_not_part_of_the_header(spark, tmp_path):
    path = write(tmp_path, "areas.csv", "AreaID,Name\n1,Bay\n", "utf-8-sig")
    df = readers.read_delim(spark, path, ddl("AreaID int, Name string"), sep=",", null=None)
    assert values(df) == [(1, "Bay")]


def test_missing_column_and_bad_value_are_errors(spark, tmp_path):
    path = write(tmp_path, "a.txt", "x|y\n1|z\n")
    with pytest.raises(ValueError, match="no column"):
        readers.read_delim(spark, path, ddl("w int"))
    with pytest.raises(Exception):
        readers.read_delim(spark, path, ddl("y int")).collect()


def test_layouts_are_united_by_name(spark, tmp_path):
    """A folder with exports of different columns and sizes, read both ways and together."""
    root = tmp_path / "in"
    write(root, "All_OYSTER_x.txt", "a|b|c\n" + "1|2|3\n" * 50)
    write(root, "WQ_cont_x.txt", "y|x\n5|6\n")
    write(root, "WQ_cont_y.txt", "x|z|y\n7|8|9\n")
    write(root, "WQ_cont_empty.txt", "")
    read = lambda spec, **kw: values(readers.read_delim(spark, str(root), ddl(spec), **kw))
    assert read("x int, y int", include="_cont_") == [(6, 5), (7, 9)]
    assert read("a int", include="^All_") == [(1,)] * 50
    assert read("x int, z int", include="_cont_") == [(6, None), (7, 8)]
    assert readers.read_delim(spark, str(root), ddl("x int"), include="nothing").count() == 0
    with pytest.raises(ValueError, match="no column"):
        read("a int", include="_cont_")


@pytest.mark.parametrize("form", ["{root}", "file://{root}", "{root}/*", "{root}/WQ_[c]ont_a.txt", "{root}/WQ_cont_a.txt"])
def test_the_root_never_matches(spark, tmp_path, form):
    root = tmp_path / "cont" / "in" / "cont"
    write(root, "WQ_cont_a.txt", "v\n1\n")
    path = form.format(root=root)
    read = lambda **kw: [r[0] for r in values(readers.read_delim(spark, path, ddl("v int"), **kw))]
    assert read(exclude="in/") == [1] and read(include="^cont/") == [] and read(include="^WQ") == [1]


def test_tables_of_different_columns(spark, tmp_path):
    a, b = spark.createDataFrame([(1,)], "n int"), spark.createDataFrame([(2, "x")], "n int, extra string")
    paths = list(tables.write_tables({"a": a, "b": b}, str(tmp_path)).values())
    for order in (paths, paths[::-1]):
        assert values(readers.read_tables(spark, order), "n", "extra") == [(1, None), (2, "x")]


@pytest.fixture()
def exports(tmp_path):
    root = tmp_path / "exports_cont_root"
    for name, value in {
        "All_SAV_Parameters.txt": 1, "All_CORAL_Parameters.txt": 2, "WQ_cont_DO_NE.txt": 3,
        "WQ_cont_DO_SW.txt": 4, "WQ_NUT_DO.txt": 5, "archive/old/WQ_cont_DO_SW.txt": 6,
    }.items():
        write(root, name, f"v\n{value}\n")
    return str(root)


def test_file_selection(spark, exports):
    read = lambda **kw: [r[0] for r in values(readers.read_delim(spark, exports, ddl("v int"), **kw))]
    assert read(include="_cont_") == [3, 4, 6]
    assert read(include="_cont_", exclude="archive/") == [3, 4]
    assert read(include=["_cont_", "_SW"], exclude="^WQ") == [6]
    assert read(include="^WQ", exclude="_cont_") == [5]


def test_habitat_from_the_file_name(spark, exports):
    df = readers.read_delim(spark, exports, ddl("v int"), include="^All_", with_file=True)
    from tidewater.functions.text import file_token

    assert values(df.select(file_token(F.col(readers.FILE), 1), "v")) == [("CORAL", 2), ("SAV", 1)]


def test_folder_names_with_blanks(spark, tmp_path):
    root = tmp_path / "SAV root +1"
    write(root, "sub dir/All_SAV_x.txt", "v\n1\n")
    write(root, "All_CW_x.txt", "v\n2\n")
    df = readers.read_delim(spark, str(root), ddl("v int"), include="SAV", with_file=True)
    assert values(df) == [(1, "sub dir/All_SAV_x.txt")]
    assert values(readers.list_files(spark, str(root), include="^All"), readers.FILE) == [("All_CW_x.txt",)]


def test_list_files(spark, exports):
    got = values(readers.list_files(spark, exports, include="DO", exclude="_SW", suffix=".txt"), readers.FILE, "length")
    assert got == [("WQ_NUT_DO.txt", 4), ("WQ_cont_DO_NE.txt", 4)]


def test_unwanted_files_are_not_read(spark, exports):
    df = readers.read_delim(spark, exports, ddl("v int"), include="SAV")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    metrics = plan.collectLeaves().head().metrics()
    assert metrics.apply("numFiles").value() == 1


def jobs_of(spark, run):
    """Spark jobs that ``run`` starts."""
    group = f"g{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    """Jobs and rows on the driver follow the layouts, not the files."""
    few, many = tmp_path / "few", tmp_path / "many"
    for root, n in ((few, 200), (many, 500)):
        for i in range(n):
            write(root, f"sub{i % 7}/WQ_cont_{i}.txt", ("x|y\n" if i % 5 else "\n \ny|z|x\n") + (f"{i}|1\n" if i % 5 else f"1|q|{i}\n"))
        write(root, "other.txt", "never|read\n")
    frames = {}

    def read(root):
        frames[root] = readers.read_delim(spark, str(root), ddl("x int, y int"), include="WQ_cont")

    assert jobs_of(spark, lambda: read(few)) == jobs_of(spark, lambda: read(many))
    assert sorted(r.x for r in frames[many].collect()) == list(range(500))
    assert frames[many].agg(F.sum("y")).first()[0] == 500
    census = readers.header_census(spark, str(many), include="WQ_cont")
    assert sorted(map(tuple, census.groupBy("header").count().collect())) == [("x|y", 400), ("y|z|x", 100)]


@pytest.mark.parametrize("small", [0, 1 << 24])
def test_headers_of_large_and_odd_files(spark, tmp_path, monkeypatch, small):
    """One task per file whatever its size; blank lines, quotes, marks and nameless columns."""
    monkeypatch.setattr(readers, "SMALL_FILE", small)
    write(tmp_path, "a/big.txt", "\n\n\"n|m\"|v\n" + "1|2\n" * 200_000)
    write(tmp_path, "a/blank.txt", "\n  \n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.read_delim(spark, str(tmp_path / "a"), T.StructType([T.StructField("v", T.IntegerType()), T.StructField("n|m", T.IntegerType())]))
        assert df.rdd.getNumPartitions() > 100
        assert df.agg(F.sum("v"), F.sum("`n|m`")).first() == (400_000, 200_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    write(tmp_path, "b/x.csv", "v,,w\n1,2,3\n", "utf-8-sig")
    write(tmp_path, "b/y.csv", "w,v\n5,6\n")
    assert values(readers.read_delim(spark, str(tmp_path / "b"), ddl("w int, v int"), sep=",")) == [(3, 1), (5, 6)]
    assert readers.header_names('a||"b|c"|', "|") == ["a", "_c1", "b|c", "_c3"]


def test_duplicate_tables(spark, tmp_path):
    rows = lambda data: spark.createDataFrame(data, "p string, r string, n int")
    paths = tables.write_tables(
        {"export_1": rows([("DO", "NE", 1), ("DO", "SW", 2), (None, "SW", 9)]), "export_2": rows([("DO", "NE", 5), ("DO", "NE", 6)])},
        str(tmp_path),
    )
    paths = list(paths.values())
    assert values(readers.read_tables(spark, paths), "n") == [(1,), (2,), (5,), (6,), (9,)]
    last = readers.read_tables(spark, paths, "last", ["p", "r"], r"export_\d+")
    assert values(last) == [("DO", "NE", 5), ("DO", "NE", 6), ("DO", "SW", 2), (None, "SW", 9)]
    with pytest.raises(ValueError):
        readers.read_tables(spark, paths, "last")


def test_rule_based_inputs(spark):
    files = spark.createDataFrame(
        [("DO", "Field", "All", 1), ("DO", "Lab", "All", 2), ("Secchi", "Field", "Surface", 3), ("XX", "Lab", "All", 4)],
        "param string, activity string, depth string, f int",
    )
    rules = dimensions.input_rules(spark)
    assert values(readers.select_inputs(files, rules), "f") == [(1,), (3,)]
    assert values(readers.select_inputs(files, rules, "data"), "f") == [(1,), (2,), (3,)]


def test_dimension_with_preamble(spark, tmp_path):
    path = write(tmp_path, "groups.txt", 'Programs\nrevised|now\nGroup|ID|Name|x\n"A|B"|1|First|\n|2|Second|y\r\n\n')
    df = dimensions.read_dimension(spark, path, ddl("ID int, Name string, Group string"), skip_rows=2)
    assert values(df) == [(1, "First", "A|B"), (2, "Second", None)]


def test_dimension_of_many_splits(spark, tmp_path):
    """The preamble is dropped from each file's top only, however the file is split."""
    body = "".join(f"{i}|n{i}\n" for i in range(400))
    for k in range(2):
        write(tmp_path, f"d/{k}.txt", "notes\nmore|notes\n" + ("ID|Name\n" + body if k else "Name|ID\nx|-1\n"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = dimensions.read_dimension(spark, str(tmp_path / "d"), ddl("ID int, Name string"), skip_rows=2)
        got = values(df)
        assert df.rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted([(i, f"n{i}") for i in range(400)] + [(-1, "x")], key=str)


def test_literal_dimensions_have_a_known_size(spark):
    plots = dimensions.plots(spark)
    assert plots.count() == len(constants.PLOTS) == 10
    stats = plots._jdf.queryExecution().optimizedPlan().stats()
    assert int(str(stats.sizeInBytes())) < 10_000
    assert dimensions.habitats(spark).count() == 5 and dimensions.parameter_units(spark).count() == 6
    rec = dimensions.records(spark, {"a": {"t": "x"}, "b": {"t": None}}, "id")
    assert values(rec) == [("a", "x"), ("b", None)]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], "NE"), (2, None, "SW")], "n int, l array<string>, Region string")
    tables.write_tables({"t": df}, str(tmp_path), "2003-01-01", {"t": ["Region"]})
    back = tables.load_table(spark, str(tmp_path), "t", view=True)
    assert values(back, "n", "l", "Region") == [(1, ["a"], "NE"), (2, None, "SW")]
    assert {str(r[0]) for r in spark.sql("SELECT publish_date FROM t").collect()} == {"2003-01-01"}


def test_scratch_follows_the_session(spark):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    a, b = scratch.scratch_path(spark, "x"), scratch.scratch_path(spark, "x")
    assert a.startswith(root) and a != b
