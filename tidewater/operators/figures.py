"""Figure files per managed area and plot type, matched by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.semantics import null_safe_join
from tidewater.functions.text import without_blanks
from tidewater.sources.constants import FIGURES_BY_NAME, FIGURES_WITHOUT_TABLE, NO_FIGURE

# Lengths of the pieces that keys and paths are joined on where a key may sit inside a longer word.
GRAMS = (1, 2, 4, 8)
TOKEN_EDGE = "[^a-z0-9]+"
ANY = ""  # piece of a key that has none of its own: every path that names the plot type holds it


def figure_key(plot_type: Column, by_name: list[str] = FIGURES_BY_NAME) -> Column:
    """What a file name calls an area: its abbreviation, or its blank-free name."""
    return F.when(plot_type.isin(by_name), without_blanks(F.col("ManagedAreaName"))).otherwise(F.col("Abbreviation"))


def figure_targets(areas: DataFrame, plot_types: list[str], by_name: list[str] = FIGURES_BY_NAME) -> DataFrame:
    """Every (area, plot type) with its key, unfolded from a literal list inside each area row."""
    types = F.explode(F.array(*[F.lit(t) for t in plot_types]))
    rows = areas.select("ManagedAreaName", "Abbreviation", types.alias("plot_type"))
    return rows.select("ManagedAreaName", "plot_type", figure_key(F.col("plot_type"), by_name).alias("key"))


def _literal(x: Column) -> Column:
    """Pattern for a name: everything literal but ``.``, which stands for any character."""
    return F.regexp_replace(F.lower(x), r"([^\p{L}\p{N}. ])", r"\\$1")


def _grams(text: Column, size: int) -> Column:
    n = F.length(text)
    pieces = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(n >= size, pieces).otherwise(F.array().cast("array<string>"))


def path_pieces(path: Column, token: bool) -> Column:
    """Distinct pieces of a path: its delimited words, or its substrings of the lengths in GRAMS."""
    pieces = F.split(path, TOKEN_EDGE) if token else F.concat(*[_grams(path, size) for size in GRAMS])
    return F.array_distinct(F.concat(F.array(F.lit(ANY)), pieces))


def key_pieces(key: Column, token: bool) -> Column:
    """Pieces of which every path that matches the key holds all.

    A dot in a key stands for any character.  So between delimiters, words next
    to a dot are no words of the path for certain and are left out.  Inside words
    the pieces are the substrings of the key's literal runs, of the largest length
    that the longest run has.  A key without a piece gets ANY.
    """
    low = F.lower(key)
    if token:
        # A dot joins its neighbours into one piece that is dropped, as it holds the dot.
        pieces = F.filter(F.split(low, "[^a-z0-9.]+"), lambda w: (w != "") & ~F.contains(w, F.lit(".")))
    else:
        runs = F.split(low, r"[^\p{L}\p{N}]+")
        longest = F.array_max(F.transform(runs, F.length))
        pieces = F.array().cast("array<string>")
        for size in GRAMS:
            pieces = F.when(longest >= size, F.flatten(F.transform(runs, lambda r: _grams(r, size)))).otherwise(pieces)  # noqa: B023
    return F.when(F.size(pieces) > 0, F.array_distinct(pieces)).otherwise(F.array(F.lit(ANY)))


def figure_candidates(targets: DataFrame, plot_types: list[str], files: DataFrame, token: bool = False) -> DataFrame:
    """(ManagedAreaName, plot_type, key, path): the pairs that a pattern has to decide.

    An inverted index holds, for every plot type and piece that some key has, the
    paths with both.  Each key takes its **rarest** piece, by the number of paths
    that hold it; a key with a piece that no path holds has no candidate.
    """
    keys = targets.where(F.col("key").isNotNull())
    pieces = keys.select("plot_type", "key", F.explode(key_pieces(F.col("key"), token)).alias("piece")).distinct()
    path = F.lower("path")
    named = F.filter(F.array(*[F.lit(t) for t in plot_types]), lambda t: F.contains(path, F.lower(t)))
    index = files.select("path", F.explode(path_pieces(path, token)).alias("piece"), named.alias("named"))
    index = index.select("path", F.explode("named").alias("plot_type"), "piece")
    wanted = pieces.select("plot_type", "piece").distinct()
    index = index.join(wanted, ["plot_type", "piece"], "left_semi")
    held = index.groupBy("plot_type", "piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = pieces.join(held, ["plot_type", "piece"], "left").groupBy("plot_type", "key").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("least")
    )
    rarest = rarest.where("least.n > 0").select("plot_type", "key", F.col("least.piece").alias("piece"))
    found = index.join(rarest, ["plot_type", "piece"])
    return found.join(keys, ["plot_type", "key"]).select("ManagedAreaName", "plot_type", "key", "path")


def match_figures(
    areas: DataFrame,
    plot_types: list[str],
    files: DataFrame,
    token: bool = False,
    by_name: list[str] = FIGURES_BY_NAME,
) -> DataFrame:
    """First figure path per (area, plot type), ``FALSE`` when there is none.

    A path matches when it holds the key of the area followed by the plot type
    (preferred) or the other way round, in any letter case.  By default the key
    may sit inside a longer word; ``token=True`` asks for delimiters around it.

    A pattern join would test every file against every pattern.  Instead each key
    meets the files of its rarest piece (``figure_candidates``), and the pattern
    decides among these.  The first path is a partial aggregate, so popular areas
    cost no large group.
    """
    targets = figure_targets(areas, plot_types, by_name)
    found = figure_candidates(targets, plot_types, files, token)
    path = F.lower("path")
    key, kind = _literal(F.col("key")), _literal(F.col("plot_type"))
    if token:
        edge, start, end = "[^a-z0-9]", "(^|[^a-z0-9])", "($|[^a-z0-9])"
        between = f"{edge}(.*{edge})?"
    else:
        start = end = ""
        between = ".*"
    forward = F.rlike(path, F.concat(F.lit(start), key, F.lit(between), kind, F.lit(end)))
    backward = F.rlike(path, F.concat(F.lit(start), kind, F.lit(between), key, F.lit(end)))
    found = found.withColumn("order", F.when(forward, 1).when(backward, 2)).where(F.col("order").isNotNull())
    first = found.groupBy("ManagedAreaName", "plot_type").agg(F.min(F.struct("order", "path")).alias("hit"))
    return null_safe_join(
        targets.select("ManagedAreaName", "plot_type"), first, ["ManagedAreaName", "plot_type"], "left"
    ).select("ManagedAreaName", "plot_type", F.coalesce("hit.path", F.lit(NO_FIGURE)).alias("path"))


def figures_wide(matches: DataFrame, plot_types: list[str]) -> DataFrame:
    """One column per plot type."""
    return matches.groupBy("ManagedAreaName").pivot("plot_type", plot_types).agg(F.max("path"))


def figures_long(wide: DataFrame, plot_types: list[str], keys: list[str] = ("ManagedAreaName",)) -> DataFrame:
    """Available figures of a wide table, one row each."""
    cols = [F.col(c) for c in plot_types]
    return wide.unpivot([F.col(k) for k in keys], cols, "plot_type", "path").where(F.col("path") != NO_FIGURE)


def available_plots(areas: DataFrame, wide: DataFrame, plots: DataFrame, habitat: str | None = None) -> DataFrame:
    """Buttons to show: available figures joined to their label, title and texts."""
    types = [c for c in wide.columns if c != "ManagedAreaName"]
    meta = plots if habitat is None else plots.where(F.col("habitat") == habitat)
    out = null_safe_join(figures_long(wide, types), meta, ["plot_type"])
    out = null_safe_join(out, areas.select("ManagedAreaName", "Abbreviation"), ["ManagedAreaName"])
    return out.select(
        "ManagedAreaName",
        "habitat",
        "plot_type",
        "path",
        "label",
        "alt",
        F.concat("title", "ManagedAreaName").alias("title"),
        F.concat_ws("__", "Abbreviation", "plot_type").alias("button_id"),
        (~F.col("plot_type").isin(FIGURES_WITHOUT_TABLE)).alias("has_table"),
    )
