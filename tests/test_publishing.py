"""Tables that are replaced while plans read them."""

import os

import pytest
from pyspark.sql import functions as F

from catalog import fixtures as X
from tidewater.plans import batch as runs
from tidewater.sources import tables

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_table_may_be_read_by_the_plan_that_replaces_it(spark, tmp_path):
    root = str(tmp_path)
    tables.write_tables({"t": spark.createDataFrame([(1, "a")], "n int, s string")}, root)
    for k in (2, 3):
        old = tables.load_table(spark, root, "t")
        more = spark.createDataFrame([(k, "b")], "n int, s string")
        tables.write_tables({"t": old.unionByName(more)}, root)
        assert len(rows(old)) == k - 1  # opened before the switch
    assert rows(tables.load_table(spark, root, "t")) == [(1, "a"), (2, "b"), (3, "b")]
    assert rows(tables.load_table(spark, root, "t", age=1)) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="no version"):
        tables.load_table(spark, root, "t", age=3)


def test_a_failing_write_leaves_the_table(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1,)], "n int")
    tables.write_tables({"a": df, "b": df}, root)
    bad = df.select(F.raise_error(F.lit("stopped")).cast("int").alias("n"))
    with pytest.raises(Exception, match="stopped"):
        tables.write_tables({"a": df.withColumn("n", F.lit(2)), "b": bad}, root)
    assert rows(tables.load_table(spark, root, "a")) == rows(tables.load_table(spark, root, "b")) == [(1,)]


def test_a_stop_between_write_and_switch(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    df = spark.createDataFrame([(1,)], "n int")
    tables.write_tables({"t": df}, root)

    def stopped(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(tables, "publish", stopped)
    with pytest.raises(KeyboardInterrupt):
        tables.write_tables({"t": df.union(df)}, root)
    assert rows(tables.load_table(spark, root, "t")) == [(1,)]
    monkeypatch.undo()
    tables.write_tables({"t": df.union(df)}, root)
    assert rows(tables.load_table(spark, root, "t")) == [(1,), (1,)]


def test_versions_and_their_removal(spark, tmp_path):
    root = str(tmp_path)
    assert tables.versions(spark, root).count() == 0
    for k in range(4):
        tables.write_tables({"t": spark.range(k), "u": spark.range(1)}, root, "2003-01-01", {"t": ["publish_date"]})
    got = tables.versions(spark, root).where("name = 't'").orderBy("age").select("age", "serial", "n_rows")
    assert [tuple(r) for r in got.collect()] == [(0, 4, 3), (1, 3, 2), (2, 2, 1), (3, 1, 0)]
    assert len(tables.drop_old(spark, root, keep=2)) == 4
    assert tables.load_table(spark, root, "t").count() == 3 and tables.load_table(spark, root, "t", age=1).count() == 2
    assert len(os.listdir(f"{root}/t")) == 2 and tables.drop_old(spark, root, keep=2) == []
    with pytest.raises(ValueError):
        tables.drop_old(spark, root, keep=0)


def test_plain_folders_are_found(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/plain")
    assert tables.load_table(spark, str(tmp_path), "plain").count() == 3


def test_a_batch_whose_inputs_are_its_own_last_tables(spark, tmp_path):
    obs = X.obs(spark, SF_DIR)
    one = F.col("ProgramLocationID") == 3
    root = str(tmp_path)

    def run(stats, monthly, archive):
        return runs.run_continuous(
            spark, obs.where(~one), X.dim_entity(spark, SF_DIR), stats, monthly, obs.withColumnRenamed("Habitat", "habitat"),
            X.points(spark, SF_DIR), root, X.AS_OF, X.LINK, highlights=X.HIGHLIGHTS, archive=archive,
        )

    stats, monthly = X.trend_rows(spark, SF_DIR), X.monthly(spark, SF_DIR)
    first = run(stats.where(~one), monthly.where(~one), runs.Archive([3], obs.where(one), stats.where(one), monthly))
    want = {name: rows(tables.load_table(spark, root, name)) for name in first}
    load = lambda name: tables.load_table(spark, root, name)
    for _ in range(2):
        earlier = runs.Archive([3], obs.where(one), load("trend_rows"), load("monthly_means"))
        again = run(load("trend_rows").where(~one), load("monthly_means").where(~one), earlier)
        assert set(again) == set(first) and not set(again.values()) & set(first.values())
        assert {name: rows(load(name)) for name in again} == want
