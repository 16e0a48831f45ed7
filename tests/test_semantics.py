"""Missing-value, text and number rules."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import dates, text
from tidewater.functions.semantics import (
    distinct_with_null,
    member,
    na_case,
    na_max,
    na_mean,
    na_min,
    null_safe_join,
    round_half_even,
    set_with_null,
    sorted_set,
)


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame(
        [("full", 1.0), ("full", 3.0), ("gap", 1.0), ("gap", None), ("gap", 1.0), ("none", None)], "g string, x double"
    )


def test_missing_is_contagious_in_aggregates(groups):
    got = {
        r["g"]: tuple(r)[1:]
        for r in groups.groupBy("g").agg(na_mean("x"), na_min("x"), na_max("x")).collect()
    }
    assert got == {"full": (2.0, 1.0, 3.0), "gap": (None,) * 3, "none": (None,) * 3}


def test_missing_is_a_distinct_value(groups):
    got = dict(groups.groupBy("g").agg(distinct_with_null("x")).collect())
    assert got == {"full": 2, "gap": 2, "none": 1}
    assert groups.where("g = 'nowhere'").agg(distinct_with_null("x")).first()[0] == 0


def test_sets_drop_or_keep_missing(groups):
    rows = groups.groupBy("g").agg(sorted_set("x"), set_with_null("x")).collect()
    got = {r[0]: (r[1], r[2]) for r in rows}
    assert got == {"full": ([1.0, 3.0], [1.0, 3.0]), "gap": ([1.0], [1.0, None]), "none": ([], [None])}


def test_membership_is_never_unknown(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [r[0] for r in df.where(member("x", ["a"])).collect()] == ["a"]
    assert [r[0] for r in df.where(~member("x", ["a"])).collect()] == ["b", None]
    assert [r[0] for r in df.where(member("x", ["a", None])).collect()] == ["a", None]
    assert df.where(member("x", [])).count() == 0


def test_unknown_condition_ends_a_case(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, c boolean")
    out = df.select("i", na_case((F.col("c"), "yes"), (F.lit(True), "second")).alias("v")).collect()
    assert dict(out) == {1: "yes", 2: "second", 3: None}


def test_join_matches_missing_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(1, 10), (None, 20), (3, 30)], "id int, b int")
    rows = {tuple(r) for r in null_safe_join(a, b, [("k", "id")]).collect()}
    assert rows == {(1, "x", 10), (None, "y", 20)}
    left = {tuple(r) for r in null_safe_join(a, b, [("k", "id")], "left").collect()}
    assert left == rows | {(2, "z", None)}


def test_rounding_follows_the_stored_value(spark):
    cases = {(0.15, 1): 0.1, (0.25, 1): 0.2, (0.35, 1): 0.3, (0.55, 1): 0.6, (2.5, 0): 2.0, (3.5, 0): 4.0,
             (-0.285, 2): -0.28, (1e300, 2): 1e300, (7.0, 2): 7.0}
    for (x, d), want in cases.items():
        got = spark.range(1).select(round_half_even(F.lit(x), d)).first()[0]
        assert got == pytest.approx(want, abs=1e-12), (x, d)


def test_paste_and_number_text(spark):
    df = spark.createDataFrame([(1, None, 2.0), (None, "b", 2.25), (3, "c", -0.001)], "i int, s string, x double")
    rows = df.select(
        text.paste(F.col("i"), "-", F.col("s")), text.number_text(F.round("x", 2)),
        text.interval_text(F.col("x"), F.col("x") + 1),
    ).collect()
    assert [tuple(r) for r in rows] == [("1-NA", "2", "2 to 3"), ("NA-b", "2.25", "2.25 to 3.25"), ("3-c", "0", "0 to 1")]


def test_text_functions(spark):
    df = spark.createDataFrame([("button_DO_FK_01", "/a/b/All_SAV_2024.txt", 1234567)], "id string, path string, n bigint")
    row = df.select(
        text.id_part(F.col("id"), 1, 3), text.id_part(F.col("id"), 2, 3), text.file_token(F.col("path"), 1),
        text.file_token(F.col("path"), 9), text.thousands("n"), text.without_blanks(F.lit("a b  c")),
        text.short_names(F.lit("Aquatic Preserves Continuous Water Quality Monitoring"), [("Aquatic Preserves Continuous Water Quality Monitoring", "APCWQ")]),
        text.axis_label(F.lit("pH"), F.lit("pH")), text.axis_label(F.lit("Salinity"), F.lit("ppt")),
        text.linked_name(F.lit(None).cast("string"), F.lit("n")), text.list_text(F.array(F.lit(1), F.lit(None))),
    ).first()
    assert tuple(row) == (
        "DO", "FK_01", "SAV", None, "1,234,567", "abc", "APCWQ", "pH", "Salinity (ppt)", "n", "1, NA",
    )


def test_calendar_rules(spark):
    row = spark.range(1).select(
        dates.cutoff_year("2024-02-29"), dates.cutoff_year("2003-01-01"),
        F.round(dates.decimal_year(F.lit("2020-07-01")), 5), dates.decimal_year(F.lit("2021-01-01")),
        dates.status_of(F.lit(2002), "2003-06-01"), dates.status_of(F.lit(2001), "2003-06-01"),
        dates.status_of(F.lit(None).cast("int"), "2003-06-01"),
    ).first()
    assert tuple(row) == (2023, 2002, 2020.49727, 2021.0, "Active", "Historical", None)


@pytest.mark.parametrize("lo,hi,step,axis,ticks", [
    (1980, 2015.5, 10, (1979.75, 2015.75), [2016, 2006, 1996, 1986]),
    (2000, 2012.5, 4, (1999.75, 2012.75), [2012, 2008, 2004, 2000]),
    (2000, 2006.25, 2, (1999.75, 2006.5), [2006, 2004, 2002, 2000]),
    (2000, 2003.0, 1, (1999.75, 2003.25), [2003, 2002, 2001, 2000]),
    (2000, 2000.5, 1, (1998.75, 2001.75), [2000, 1999]),
])
def test_trend_axis(spark, lo, hi, step, axis, ticks):
    row = spark.range(1).select(dates.trend_axis(F.lit(lo), F.lit(float(hi))).alias("a")).first()["a"]
    assert (row["step"], (row["axis_lo"], row["axis_hi"]), row["ticks"]) == (step, axis, ticks)


def test_ticks_of_an_inverted_range_are_missing(spark):
    row = spark.range(1).select(dates.coverage_ticks(F.lit(2000), F.lit(1999)), dates.coverage_ticks(F.lit(1999), F.lit(2003))).first()
    assert tuple(row) == (None, [2003, 2001, 1999])


def test_numbers_in_text(spark):
    """Whole doubles without decimals, large ones without an exponent, text as it is."""
    df = spark.createDataFrame([(5.0, 12345678.25, "v1.0", 7), (2.5, 1e15, None, None)], "a double, b double, c string, d int")
    out = df.select(text.paste(F.col("a"), "|", F.col("c"), "|", F.col("d")), text.interval_text(F.col("b"), F.col("a")))
    assert [tuple(r) for r in out.collect()] == [("5|v1.0|7", "12345678.25 to 5"), ("2.5|NA|NA", "1000000000000000 to 2.5")]
