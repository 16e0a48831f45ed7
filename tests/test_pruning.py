"""What is not needed is not read: partials per export, partitions, Bloom filters, row groups, grains."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import fixtures as X
from tidewater.functions.semantics import choosing
from tidewater.operators import clean, joins, rollups
from tidewater.plans import continuous, habitat, partials
from tidewater.sources import dimensions, readers, tables

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def executed(df):
    """(plan text after a run, its nodes)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    while "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()
    return text, plan


def nodes(plan, name):
    out = [plan] if name in plan.nodeName() else []
    if "QueryStage" in plan.nodeName():
        return out + nodes(plan.plan(), name)
    children = plan.children()
    for i in range(children.size()):
        out += nodes(children.apply(i), name)
    return out


def metric(node, name):
    return node.metrics().apply(name).value()


# --- partials per export ----------------------------------------------------

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("p", "r", "code")] + [T.StructField("n", T.LongType())])


def put(spark, store, export, data):
    store.put(export, spark.createDataFrame(data, SCHEMA))


@pytest.fixture()
def store(spark, tmp_path):
    out = partials.PartialStore(spark, str(tmp_path / "store"), SCHEMA, ("p", "r"))
    assert out.read().count() == 0
    put(spark, out, "e1", [("DO", "NE", "007", 1), ("DO", "SW", "1", 2), (None, "SW", "x", 9)])
    put(spark, out, "e2", [("DO", "NE", "008", 5), ("DO", "NE", None, 6)])
    put(spark, out, "e3", [("pH", "NE", "1", 7)])
    return out


def test_exports_add_up_or_the_last_one_wins(store):
    assert rows(store.read().select("n")) == [(n,) for n in (1, 2, 5, 6, 7, 9)]
    last = store.read("last").select("p", "r", "code", "n", "export")
    assert rows(last) == sorted(
        [("DO", "NE", "008", 5, "e2"), ("DO", "NE", None, 6, "e2"), ("DO", "SW", "1", 2, "e1"), ("pH", "NE", "1", 7, "e3"), (None, "SW", "x", 9, "e1")],
        key=str,
    )
    with pytest.raises(ValueError):
        store.read("first")


def test_a_replaced_export(spark, store):
    files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.root}/unit=*/*.parquet")}
    put(spark, store, "e2", [("DO", "SW", "9", 10)])
    now = glob.glob(f"{store.root}/unit=*/*.parquet")
    assert len(now) == len(files) + 1 and all(os.stat(f).st_mtime_ns == t for f, t in files.items())
    assert rows(store.read().select("n")) == [(1,), (10,), (2,), (7,), (9,)]
    assert rows(store.read("last").select("n")) == [(1,), (10,), (7,), (9,)]
    store.put("e2", spark.createDataFrame([], SCHEMA))
    assert rows(store.read("last").select("n")) == [(1,), (2,), (7,), (9,)]
    store.put("e4", spark.createDataFrame([], SCHEMA))
    assert store.read().count() == 4


def test_losing_files_are_not_opened(spark, store):
    """Old versions and losing units hold rubbish: the read still works, and counts the files it opens."""
    put(spark, store, "e3", [("pH", "NE", "1", 8)])
    held = {(r.export, r.p, r.r, r.serial): r.unit for r in store.manifest().collect()}
    lost = [held["e1", "DO", "NE", 1], held["e3", "pH", "NE", 3]]
    for f in (f for unit in lost for f in glob.glob(f"{store.root}/unit={unit}/*.parquet")):
        os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
        with open(f, "wb") as out:
            out.write(b"rubbish")
    df = store.read("last")
    assert rows(df.select("n")) == [(2,), (5,), (6,), (8,), (9,)]
    text, plan = executed(df)
    assert "dynamicpruning" in text
    files = [metric(n, "numFiles") for n in nodes(plan, "Scan parquet") if "code#" in n.toString()]
    assert files == [len(glob.glob(f"{store.root}/unit=*/*.parquet")) - 2]


def test_merged_partials_equal_a_full_run(spark, tmp_path):
    obs = X.obs(spark, SF_DIR)
    parts = {f"export {k}": obs.where(F.col("LocationID") % 3 == k) for k in range(3)}
    schema = partials.station_partials(obs).schema
    store = partials.PartialStore(spark, str(tmp_path / "years"), schema, ("Parameter", "Region"))
    for name, part in parts.items():
        store.put(name, partials.station_partials(part.where("Year < 1998") if name == "export 1" else part))
    store.put("export 1", partials.station_partials(parts["export 1"]))  # replaced by the whole export
    want = continuous.station_years(obs)
    assert rows(partials.station_years(store.read()).select(*want.columns)) == rows(want)

    gated = habitat.gated(X.habitat_obs(spark, SF_DIR), X.FLAGS, ["SMALL"])
    reduced = lambda df: rollups.value_cells(df, habitat.CELL_KEYS)
    store = partials.PartialStore(spark, str(tmp_path / "cells"), reduced(gated).schema, (habitat.HABITAT, "ParameterName"))
    for k in range(3):
        store.put(f"e{k}", reduced(gated.where(F.col("LocationID") % 3 == k)))
    cells = joins.attach_units(partials.merged_cells(store.read()), X.thresholds(spark, SF_DIR))
    want = X.habitat_cells(spark, SF_DIR)
    assert rows(cells.select(*want.columns)) == rows(want)


# --- partitions and Bloom filters -------------------------------------------


@pytest.mark.parametrize("filetype,opened", [(None, 2), ("data", 4)])
def test_rules_prune_folders(spark, tmp_path, filetype, opened):
    root = str(tmp_path)
    data = [(p, a, d, i) for i, (p, a, d) in enumerate((p, a, d) for p in ("DO", "Secchi", "XX") for a in ("Field", "Lab") for d in ("All",))]
    files = spark.createDataFrame(data, "param string, activity string, depth string, v int")
    keys = ["param", "activity", "depth"]
    rules = spark.createDataFrame([("DO", "Field", "All"), ("Secchi", "Lab", "All"), ("DO", "Field", "All")], "param string, activity string, depth string")
    tables.write_tables({"inputs": files, "rules": rules}, root, partition_by={"inputs": keys})
    df = readers.select_inputs(tables.load_table(spark, root, "inputs"), tables.load_table(spark, root, "rules"), filetype)
    assert df.count() == opened
    text, plan = executed(df)
    assert "dynamicpruning" in text
    scans = [n for n in nodes(plan, "Scan parquet") if "dynamicpruning" in n.toString()]
    assert [metric(n, "numFiles") for n in scans] == [opened]


@pytest.mark.parametrize("how", ["archive", "known"])
def test_archives_are_filtered_before_the_shuffle(spark, tmp_path, how):
    root = str(tmp_path)
    big = spark.range(200_000).selectExpr("id % 20000 AS station", "id AS v", "CAST(NULL AS STRING) AS more")
    keys = spark.range(0, 20_000, 400).select(F.col("id").alias("station"))
    tables.write_tables({"archive": big, "keys": keys}, root)
    archive, wanted = tables.load_table(spark, root, "archive"), tables.load_table(spark, root, "keys")
    current = archive.where("v < 0")
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        df = clean.backfill(current, archive, "station", wanted) if how == "archive" else joins.known_only(archive, wanted, ["station"])
        text, plan = executed(df)
        assert "might_contain" in text and "Broadcast" not in text
        shuffled = [metric(n, "shuffleRecordsWritten") for n in nodes(plan, "Exchange") if re.search(r"\bv#", n.toString())]
        assert df.count() == 500 and max(shuffled) < 20_000
    finally:
        for k in options:
            spark.conf.unset(k)


def test_choosing_changes_no_row(spark):
    df = spark.createDataFrame([("a",), (None,), ("",)], "k string")
    assert rows(choosing(df, "k")) == rows(df) and choosing(spark.range(3), "id").count() == 3


# --- look-ups and grains ----------------------------------------------------


def test_lookups_read_few_row_groups(spark, tmp_path):
    """A hot station has a third of the rows; another is found in a small share of the row groups."""
    root = str(tmp_path)
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 997).cast("string")))
    df = spark.range(300_000).select(hot.alias("station"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    spark.conf.set("spark.hadoop.parquet.block.size", str(64 << 10))
    try:
        df = df.repartition(8)
        for name, by in (("plain", None), ("sorted", {"sorted": ["station"]})):
            tables.write_tables({name: df}, root, cluster_by=by)
    finally:
        spark.conf.unset("spark.hadoop.parquet.block.size")
    read = {}
    for name in ("plain", "sorted"):
        got = tables.load_table(spark, root, name).where("station = 's500'")
        assert got.count() == df.where("station = 's500'").count()
        _, plan = executed(got)
        read[name] = metric(nodes(plan, "Scan parquet")[0], "numOutputRows")
    assert read["plain"] > 50_000 and read["sorted"] < 30_000
    parts = tables.load_table(spark, root, "sorted").where("station = 'hot'").select(F.col("_metadata.file_path")).distinct()
    assert parts.count() > 1


def test_grains_in_one_exchange(spark, tmp_path):
    cells = X.habitat_cells(spark, SF_DIR)
    tables.write_tables({"cells": cells}, str(tmp_path))
    cells = tables.load_table(spark, str(tmp_path), "cells")
    grains = habitat.summaries(cells)
    text, plan = executed(grains)
    assert len(nodes(plan, "Scan parquet")) == 1 and len([n for n in nodes(plan, "Exchange") if n.nodeName() == "Exchange"]) == 1
    tables.write_tables({"summaries": grains}, str(tmp_path), partition_by={"summaries": ["grain"]})
    written = tables.load_table(spark, str(tmp_path), "summaries")
    for kind in ("all", "program", "area"):
        want = habitat.summary(cells, kind, cells=True)
        for got in (grains, written):
            assert rows(habitat.summary_of(got, kind).select(*want.columns)) == rows(want)
    one = habitat.summary_of(written, "program")
    _, plan = executed(one)
    assert metric(nodes(plan, "Scan parquet")[0], "numFiles") == len(
        glob.glob(f"{tables.table_path(spark, str(tmp_path), 'summaries')}/grain=program/*.parquet")
    )


def test_a_null_key_is_no_other_grain(spark):
    data = [("w", None, 1, 1, 2.0, 2.0, 2.0), ("w", "b", 2, 2, 6.0, 1.0, 5.0), (None, None, 1, 0, None, None, None)]
    cells = spark.createDataFrame(data, "h string, area string, n_rows long, n_known long, total double, lowest double, highest double")
    out = rollups.cell_summaries(cells, {"all": ["h"], "area": ["h", "area"]}).select("grain", "h", "area", "N_samples", "mean")
    assert rows(out) == sorted(
        [("all", "w", None, 3, 2.67), ("all", None, None, 1, None), ("area", "w", None, 1, 2.0), ("area", "w", "b", 2, 3.0), ("area", None, None, 1, None)],
        key=str,
    )


def test_fixed_tables(spark):
    assert dimensions.input_rules(spark).count() == 13 and dimensions.plots(spark).select("plot_type").distinct().count() == 10
