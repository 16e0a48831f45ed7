"""Counts, summaries, overviews, markers and exact area statistics."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewater.operators import areas, rollups


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_station_year_repeats_the_total_per_attribute_combination(spark):
    df = spark.createDataFrame(
        [("s", 2000, "p", 1.0)] * 3 + [("s", 2000, "q", 1.0)] * 2 + [("t", 2000, "p", None)] + [(None, 2000, "p", 1.0)],
        "st string, y int, prog string, lat double",
    )
    out = rollups.station_year(df, ["st", "y"], ["prog", "lat"])
    assert rows_of(out, "*") == sorted(
        [("s", 2000, "p", 1.0, 5), ("s", 2000, "q", 1.0, 5), ("t", 2000, "p", None, 1), (None, 2000, "p", 1.0, 1)], key=str
    )


def test_station_year_strict(spark):
    fits = spark.createDataFrame([("s", "p", 1), ("s", "q", 2), ("t", "p", 1)], "st string, a string, b int")
    assert rollups.station_year(fits, ["st"], ["a", "b"], strict=True).count() == 3
    clash = spark.createDataFrame([("s", "p", 1), ("s", "q", 2), ("s", "p", 2)], "st string, a string, b int")
    assert rollups.station_year(clash, ["st"], ["a", "b"]).count() == 3
    with pytest.raises(Exception, match="clashing lengths"):
        rollups.station_year(clash, ["st"], ["a", "b"], strict=True).collect()


def test_counts_survive_two_levels(spark):
    rng = random.Random(3)
    data = [(rng.choice("abc"), rng.randint(2000, 2004), "p") for _ in range(500)]
    df = spark.createDataFrame(data, "st string, y int, prog string")
    out = rollups.station_year(df, ["st", "y"], ["prog"]).groupBy("st").agg(F.sum("Data_N")).collect()
    assert dict(out) == {s: sum(1 for d in data if d[0] == s) for s in "abc"}


def station_years(spark):
    return spark.createDataFrame(
        [
            (1, 10, "P", "E1", None, "DO", 2000, 5, 1.0, 2.0, "NE"),
            (1, 10, "P", "E1", None, "pH", 2002, 7, 1.0, 2.0, "NE"),
            (2, 10, "P", "E1", None, "DO", 1990, 1, 1.5, 2.0, "NE"),
            (2, 10, "P", "E1", None, "DO", 1990, 1, 1.6, 2.0, "NE"),
            (3, 20, "Q", "E2", "l", "DO", None, 9, 1.0, 2.0, "SW"),
        ],
        "ProgramLocationID int, ProgramID int, ProgramName string, Entity string, link2 string, Parameter string, "
        "Year int, Data_N bigint, Lat double, Lon double, Region string",
    )


def test_station_map(spark):
    out = rollups.station_map(station_years(spark))
    got = rows_of(out, "ProgramLocationID", "years", "params", "YearMin", "YearMax", "Data_N", "Lat")
    assert got == [
        (1, [2000, 2002], ["DO", "pH"], 2000, 2002, 12, 1.0),
        (2, [1990], ["DO"], 1990, 1990, 2, 1.5),
        (2, [1990], ["DO"], 1990, 1990, 2, 1.6),
        (3, [], ["DO"], None, None, 9, 1.0),
    ]


def test_entity_overview(spark):
    got = rows_of(rollups.entity_overview(station_years(spark), "2003-01-01"), "*")
    assert got == [("E1", None, "Active", 2, 14, "DO, pH"), ("E2", "l", None, 1, 9, "DO")]


def test_value_summary_and_coverage(spark):
    df = spark.createDataFrame(
        [("a", "s1", 2000, 1.0), ("a", "s1", 2001, 2.005), ("a", None, 2001, 3.0), ("b", "s2", None, 1.0), ("b", "s2", 2001, None)],
        "g string, ProgramLocationID string, Year int, ResultValue double",
    )
    assert rows_of(rollups.value_summary(df, ["g"]), "*") == [("a", 3, 2.0, 1.0, 3.0), ("b", 2, None, None, None)]
    assert rows_of(rollups.coverage_overview(df, ["g"]), "*") == [
        ("a", 2, 3, 2, "2000 - 2001"), ("b", 1, 2, 2, "NA - NA"),
    ]


def test_summary_from_cells(spark):
    df = spark.createDataFrame(
        [("a", "s", 1.0), ("a", "s", 2.0), ("a", "t", 3.0), ("b", "s", 1.0), ("b", "t", None), ("c", "s", None)],
        "g string, st string, ResultValue double",
    )
    cells = rollups.value_cells(df, ["g", "st"])
    assert rows_of(rollups.cell_summary(cells, ["g"]), "*") == rows_of(rollups.value_summary(df, ["g"]), "*")


def test_collapse_sorts_by_value(spark):
    df = spark.createDataFrame([("a", 5009), ("a", 651), ("a", 651), ("b", None)], "g string, id int")
    assert rows_of(rollups.collapse(df, ["g"], "id"), "*") == [("a", "651, 5009"), ("b", "")]


@pytest.mark.parametrize("seed", range(3))
def test_exact_median(spark, seed):
    rng = random.Random(seed)
    data = [("hot", rng.choice([rng.gauss(0, 5), float(rng.randint(-3, 3))])) for _ in range(3000)]
    data += [("even", 1.0), ("even", 4.0), ("one", 7.5), ("flat", 2.0), ("flat", 2.0), (None, 3.0), (None, None)]
    df = spark.createDataFrame(data, "g string, x double")
    got = dict(areas.exact_median(df, ["g"], "x").collect())
    groups = {}
    for g, x in data:
        if x is not None:
            groups.setdefault(g, []).append(x)
    assert got == {g: statistics.median(xs) for g, xs in groups.items()}


def test_exact_median_with_bad_sketches(spark, monkeypatch):
    """Cut points far off the middle only change which range is ranked."""
    monkeypatch.setattr(areas, "SLACK", -0.4)
    df = spark.createDataFrame([("g", float(i)) for i in range(101)], "g string, x double")
    assert areas.exact_median(df, ["g"], "x").first()["Median"] == 50.0


def test_area_stats(spark):
    df = spark.createDataFrame(
        [
            ("A", "Marsh", 2000, 5009, "Zeta", 1.0), ("A", "Marsh", 2001, 651, "Alpha", 4.0),
            ("A", "Marsh", 2001, 651, "Alpha", 2.0), ("A", "Trees", 1999, 651, "Alpha", 4.0),
            ("C", "Marsh", 2003, 1, "One", 0.5), ("A", "Marsh", 2007, 1, "One", None),
        ],
        "ManagedAreaName string, grp string, Year int, ProgramID int, ProgramName string, ResultValue double",
    )
    everywhere = spark.createDataFrame([("A",), ("B",), ("C",)], "ManagedAreaName string")
    out = {
        (r["ManagedAreaName"], r["grp"]): r.asDict() for r in areas.area_stats(df, everywhere, ["grp"]).collect()
    }
    assert set(out) == {("A", "Marsh"), ("A", "Trees"), ("B", None), ("C", "Marsh")}
    marsh = out["A", "Marsh"]
    assert marsh["N_Data"] == 3 and marsh["N_Years"] == 2 and (marsh["EarliestYear"], marsh["LatestYear"]) == (2000, 2001)
    assert (marsh["Min"], marsh["Max"], marsh["Median"]) == (1.0, 4.0, 2.0)
    assert marsh["StandardDeviation"] == pytest.approx(statistics.stdev([1.0, 4.0, 2.0]))
    assert (marsh["Programs"], marsh["ProgramIDs"]) == ("Alpha, Zeta", "651, 5009")
    # The extremes belong to the area: its maximum was first reached in the other group.
    assert (marsh["Year_MinRichness"], marsh["Year_MaxRichness"]) == (2000, 1999)
    assert out["C", "Marsh"]["StandardDeviation"] is None
    assert (out["B", None]["N_Data"], out["B", None]["N_Years"], out["B", None]["Mean"]) == (0, 0, None)


def test_sample_deviation_of_two_values(spark):
    df = spark.createDataFrame([("x", 0.0), ("x", 0.94441446)], "g string, v double")
    assert df.groupBy("g").agg(F.stddev_samp("v")).first()[1] == pytest.approx(0.66780187, abs=1e-7)


def test_bounding_box(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", -1.0, 7.0), ("b", 0.0, 0.0)], "area string, lon double, lat double")
    assert rows_of(areas.area_bbox(df), "*") == [("a", -1.0, 5.0, 1.0, 7.0), ("b", 0.0, 0.0, 0.0, 0.0)]
    assert areas.select_area(df, "a").count() == 2
