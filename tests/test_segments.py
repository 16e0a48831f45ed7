"""Coverage segments against plain Python on random and fixed groups."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators.segments import first_per, with_status, year_gaps, year_segments


def expected_reference(years):
    years = sorted(set(years))
    cuts = [y for y, nxt in zip(years, years[1:]) if nxt != y + 1]
    bounds = [years[0]] + [c + 1 for c in cuts]
    return list(zip(bounds, [c - 1 for c in cuts] + [years[-1]]))


def collected(df):
    out = {}
    for g, lo, hi in df.select("g", "startYear", "endYear").collect():
        out.setdefault(g, []).append((lo, hi))
    return {g: sorted(v) for g, v in out.items()}


FIXED = {
    "two runs": ([2000, 2001, 2005, 2006], [(2000, 2000), (2002, 2006)], [(2000, 2001), (2005, 2006)]),
    "two single years": ([2000, 2005], [(2000, 1999), (2001, 2005)], [(2000, 2000), (2005, 2005)]),
    "late gap": ([2000, 2001, 2002, 2004], [(2000, 2001), (2003, 2004)], [(2000, 2002), (2004, 2004)]),
    "one year": ([1999], [(1999, 1999)], [(1999, 1999)]),
    "no gap": ([2000, 2001, 2002], [(2000, 2002)], [(2000, 2002)]),
}


@pytest.mark.parametrize("mode,at", [("reference", 1), ("islands", 2)])
def test_fixed_groups(spark, mode, at):
    rows = [(g, y) for g, case in FIXED.items() for y in case[0] + case[0][:1]] + [("one year", None)]
    df = spark.createDataFrame(rows, "g string, Year int")
    assert collected(year_segments(df, ["g"], mode=mode)) == {g: sorted(c[at]) for g, c in FIXED.items()}


def test_random_groups(spark):
    rng = random.Random(7)
    groups = {i: rng.choices(range(1980, 2024), k=rng.randint(1, 40)) for i in range(300)}
    df = spark.createDataFrame([(g, y) for g, ys in groups.items() for y in ys], "g int, Year int")
    ref = collected(year_segments(df, ["g"]))
    assert ref == {g: sorted(expected_reference(ys)) for g, ys in groups.items()}
    islands = collected(year_segments(df, ["g"], mode="islands"))
    assert {g: len(v) for g, v in islands.items()} == {g: len(v) for g, v in ref.items()}
    for g, runs in islands.items():
        covered = [y for lo, hi in runs for y in range(lo, hi + 1)]
        assert covered == sorted(set(groups[g]))
        assert all(a[1] + 1 < b[0] for a, b in zip(runs, runs[1:]))


def test_missing_group_key_is_a_group(spark):
    df = spark.createDataFrame([(None, 2000), (None, 2001), ("a", 2000)], "g string, Year int")
    assert collected(year_segments(df, ["g"])) == {None: [(2000, 2001)], "a": [(2000, 2000)]}


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        year_segments(spark.createDataFrame([("a", 1)], "g string, Year int"), ["g"], mode="other")


def test_year_gaps(spark):
    df = spark.createDataFrame([("a", 2000), ("a", 2000), ("a", 2003)], "g string, Year int")
    assert {tuple(r) for r in year_gaps(df, ["g"]).collect()} == {("a", 2000, 3), ("a", 2003, None)}


def test_status_of_segment_and_group(spark):
    df = spark.createDataFrame([("a", 2001), ("a", 1999), ("b", 2000), ("c", 2005), ("c", None)], "g string, endYear int")
    own = {tuple(r) for r in with_status(df, "endYear", "2002-06-30").collect()}
    assert own == {("a", 2001, "Active"), ("a", 1999, "Historical"), ("b", 2000, "Historical"), ("c", 2005, "Active"), ("c", None, None)}
    per = {r["g"]: r["Status"] for r in with_status(df, "endYear", "2002-06-30", per=["g"]).collect()}
    assert per == {"a": "Active", "b": "Historical", "c": None}


def test_first_per_uses_the_total_order(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "z"), ("a", 1, "x"), ("b", None, "w")], "k string, o int, v string")
    got = {tuple(r) for r in first_per(df, ["k"], ["o", "v"]).collect()}
    assert got == {("a", 1, "x"), ("b", None, "w")}


def test_hot_group_ships_distinct_years_only(spark):
    hot = spark.range(200_000).select(F.lit("hot").alias("g"), (F.lit(1990) + F.col("id") % 20).cast("int").alias("Year"))
    rare = spark.range(100).select(F.col("id").cast("string").alias("g"), F.lit(2000).alias("Year"))
    out = collected(year_segments(hot.unionByName(rare), ["g"]))
    assert out["hot"] == [(1990, 2009)] and len(out) == 101
