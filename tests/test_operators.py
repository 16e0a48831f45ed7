"""Gates, overrides, unions, entity join, figures and layers."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewater.operators import clean, figures, joins, layers
from tidewater.sources import dimensions
from tidewater.sources.constants import PLOTS


def values(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)


def test_gate_keep_exclude(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 0, "b"), (None, 1, "c"), (1, 1, None)], "Include int, MADup int, x string")
    assert values(clean.quality_gate(df), "x") == [("a",), (None,)]
    listed = spark.createDataFrame([("a",)], "x string")
    assert values(clean.exclude(df, "x", ["a"]), "x") == values(clean.exclude(df, "x", listed), "x") == [("b",), ("c",), (None,)]
    assert values(clean.keep(df, "x", listed), "x") == [("a",)]


def test_overrides_never_multiply_rows(spark):
    df = spark.createDataFrame([("s", 1990, "H"), ("s", 2000, "H"), ("t", 2000, "A")], "st string, endYear int, Status string")
    pins = spark.createDataFrame([("s", 2023, "A"), ("s", 2023, "A"), ("t", None, None)], "st string, endYear int, Status string")
    assert values(clean.apply_overrides(df, pins, ["st"])) == [("s", 2023, "A"), ("s", 2023, "A"), ("t", 2000, "A")]


def test_unions(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2,)], "i int")
    assert values(clean.union_loose(a, b)) == [(1, "x"), (2, None)]
    with pytest.raises(Exception):
        clean.union_strict(a, b)
    assert values(clean.backfill(a, b.unionByName(b.select((F.col("i") + 1).alias("i"))), "i", [3])) == [(1, "x"), (3, None)]


def test_order_and_category_rank(spark):
    df = spark.createDataFrame([("b", 1), ("z", 2), ("a", 1), (None, 3), ("y", None)], "e string, n int")
    assert [r["e"] for r in clean.ordered(df, ["-n", "e"]).collect()] == [None, "z", "a", "b", "y"]
    named = df.where("e IS NOT NULL")
    assert [r["e"] for r in clean.entity_order(named, "e", ["z", "y"]).collect()] == ["z", "y", "a", "b"]
    assert [r["e"] for r in clean.entity_order(named, "e", ["z", "y"], reverse=True).collect()] == ["b", "a", "y", "z"]


def test_attach_entity(spark):
    obs = spark.createDataFrame(
        [(1, "P1", "s1"), (2, "P2", "s2"), (3, "P3", "s3"), (1, "P1", None), (None, "PN", "s4")],
        "ProgramID int, ProgramName string, ProgramLocationID string",
    )
    dim = spark.createDataFrame([(1, "P1", "Top"), (2, "P2", None), (9, "P9", "None here")], "ProgramID int, ProgramName string, Entity string")
    out = joins.attach_entity(obs, dim, ["Top"], "u/", always_linked=["P3"])
    assert values(out, "ProgramLocationID", "Entity", "link", "link2") == [
        ("s1", "Top", "u/1", None), ("s2", "P2", "u/2", "u/2"), ("s3", "P3", "u/3", None), ("s4", "PN", None, None),
    ]


def test_threshold_habitat(spark):
    names = ["Nekton", "Oyster Reef", "Coral Reef", "Coastal Wetlands", None]
    df = spark.createDataFrame([(n,) for n in names], "h string")
    got = dict(df.select("h", joins.threshold_habitat(F.col("h"))).collect())
    assert got == {
        "Nekton": "Water Column", "Oyster Reef": "Oyster/Oyster Reef", "Coral Reef": "Coral/Coral Reef",
        "Coastal Wetlands": "Coastal Wetlands", None: None,
    }


AREAS = [
    ("Alpha Bay Preserve", "ABAP"), ("Great Alpha Bay Preserve", "GABAP"), ("St. John River-Cape Marsh", "SJ"),
    ("Nowhere", "ZZZ"), ("Key (North)", "KN"), ("No Short Name", None),
]
FILES = [
    "www/figures/gabap_multiplot.png", "www/figures/multiplot_ABAP.png", "www/figures/x/ABAP-trendplot_2.png",
    "www/figures/St.JohnRiver-CapeMarsh_Coral_pc.png", "www/figures/StXJohnRiver-CapeMarsh_Coral_pc.png",
    "www/figures/Key(North)_coral_pc.png", "www/figures/SJ_Oyster_SH.png", "www/figures/oyster_sh_KN_b.png",
    "www/figures/ABAP.png", "www/figures/multiplot.png", "s", "", "www/figures/Oyster_SH_SJ.png",
]
TYPES = ["multiplot", "trendplot", "Coral_pc", "Oyster_SH"]


def expected_figures(token):
    out = {}
    for name, short in AREAS:
        for kind in TYPES:
            key = name.replace(" ", "") if kind == "Coral_pc" else short
            found = []
            if key is not None:
                pattern = re.escape(key).replace(r"\.", ".")
                b, m, e = ("(^|[^a-z0-9])", "[^a-z0-9](.*[^a-z0-9])?", "($|[^a-z0-9])") if token else ("", ".*", "")
                for rank, (x, y) in enumerate([(pattern, kind), (kind, pattern)]):
                    found += [(rank, f) for f in FILES if re.search(b + x + m + y + e, f, re.I)]
            out[name, kind] = min(found)[1] if found else "FALSE"
    return out


@pytest.mark.parametrize("token", [False, True])
def test_figures_equal_brute_force(spark, token):
    areas = spark.createDataFrame(AREAS, "ManagedAreaName string, Abbreviation string")
    files = spark.createDataFrame([(f,) for f in FILES], "path string")
    got = figures.match_figures(areas, TYPES, files, token=token)
    want = expected_figures(token)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == want
    wide = figures.figures_wide(got, TYPES)
    assert {(r[0], r[1]): r[2] for r in figures.figures_long(wide, TYPES).collect()} == {
        k: v for k, v in want.items() if v != "FALSE"
    }


@pytest.mark.parametrize("token", [False, True])
def test_rare_pieces_leave_few_candidates(spark, token):
    """Keys of one, two and eight characters among 3,000 paths: as many candidates as the rarest piece allows."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    paths = [f"figs/{word(1)}_{word(2)}-{word(8)}_multiplot_{i}.png" for i in range(3000)]
    keys = [paths[0][5:6], paths[0][7:9], paths[0][10:18], f"{paths[1][7:9]}-{paths[1][10:18]}", "zz", "q.q"]
    targets = spark.createDataFrame([(f"n{k}", "multiplot", k) for k in keys], "ManagedAreaName string, plot_type string, key string")
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = Counter(r["key"] for r in figures.figure_candidates(targets, ["multiplot", "trendplot"], files, token).collect())
    for k in keys[:4]:
        if token:
            want = min(sum(w in re.split("[^a-z0-9]+", p) for p in paths) for w in k.split("-"))
        else:
            size = 1 if len(k) == 1 else 2 if len(k) == 2 else 8
            runs = [r for r in k.split("-") if len(r) >= size]
            want = min(sum(r[i : i + size] in p for p in paths) for r in runs for i in range(len(r) - size + 1))
        assert got[k] == want
    assert got[keys[2]] <= 3 and got[keys[3]] <= 3 and got["zz"] == 0
    assert got["q.q"] == (len(paths) if token else 0)
    matches = sum(keys[2] in p for p in paths)
    assert 1 <= matches <= got[keys[2]]


def test_tokens_are_indexed_once(spark):
    rows = spark.createDataFrame([("www/a_b/A-bc.PNG",)], "path string")
    pieces = lambda token: rows.select(F.explode(figures.path_pieces(F.lower("path"), token)).alias("p")).collect()
    assert sorted(r.p for r in pieces(True)) == ["", "a", "b", "bc", "png", "www"]
    assert len(pieces(False)) > 40


def test_substring_match_is_kept_by_default_and_dropped_with_token(spark):
    assert expected_figures(False)["Alpha Bay Preserve", "multiplot"].endswith("gabap_multiplot.png")
    assert expected_figures(True)["Alpha Bay Preserve", "multiplot"].endswith("multiplot_ABAP.png")


def test_available_plots(spark):
    areas = spark.createDataFrame([("Alpha Bay", "AB"), ("Beta", "BB")], "ManagedAreaName string, Abbreviation string")
    files = spark.createDataFrame([("f/AB_multiplot.png",), ("f/AB_barplot_sp.png",), ("f/AB_Oyster_SH.png",)], "path string")
    types = [p[0] for p in PLOTS]
    wide = figures.figures_wide(figures.match_figures(areas, types, files), types)
    out = figures.available_plots(areas, wide, dimensions.plots(spark), "Submerged Aquatic Vegetation")
    assert values(out, "ManagedAreaName", "plot_type", "has_table", "button_id", "title") == [
        ("Alpha Bay", "barplot_sp", False, "AB__barplot_sp", "Frequency of occurrence for Alpha Bay"),
        ("Alpha Bay", "multiplot", True, "AB__multiplot", "Median percent cover for Alpha Bay"),
    ]


def test_layers(spark):
    marks = spark.createDataFrame([("E1", "Active", 1), ("E1", "Historical", 2), ("E2", None, 3)], "Entity string, Status string, m int")
    assert values(layers.assign_layers(marks), "m", "layer") == [
        (1, "All_Active"), (1, "E1_by_entity_Active"), (2, "All_Historical"), (2, "E1_by_entity_Historical"),
    ]
    grid = layers.layer_grid(marks)
    assert grid.count() == 4
    hidden = layers.layer_diff(grid, layers.assign_layers(marks))
    assert values(hidden) == [("E2_by_entity_Active",), ("E2_by_entity_Historical",)]
    for choice, shown, want in [("All", ["Active"], {"All_Active"}), ("E2", ["Active", "Historical"], {"E2_by_entity_Active", "E2_by_entity_Historical"}), ("E1", [], set())]:
        rows = layers.layer_visibility(marks, choice, shown)
        assert rows.count() == 6 and {r["layer"] for r in rows.where("visible").collect()} == want
    pts = spark.createDataFrame([("Oyster",), ("OYSTER",), ("sav",), ("other",), (None,)], "habitat string")
    assert values(layers.habitat_layers(pts), "layer") == [("OYSTER",), ("OYSTER",), ("SAV",)]
