"""Counts, value summaries, coverage overviews and marker tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.dates import status_of
from tidewater.functions.semantics import (
    distinct_with_null,
    na_max,
    na_mean,
    na_min,
    round_half_even,
    set_with_null,
    sorted_set,
)
from tidewater.functions.text import detail_link, id_name, period_text


def row_count(n: str | None = None) -> Column:
    """Rows, or the rows behind a reduced table whose column ``n`` counts them."""
    return F.sum(n) if n else F.count(F.lit(1))


def station_year(
    df: DataFrame, keys: list[str], attrs: list[str], n: str = "Data_N", strict: bool = False
) -> DataFrame:
    """Observations per key, on every distinct attribute combination of that key.

    Each combination carries the count of the whole key.  Rows are first
    reduced to (key, attributes) with a partial aggregate; the total is a window
    over that reduction, which has a few rows per key, so the observations are
    scanned once whatever columns or filters follow.

    ``strict`` raises where the combinations of a key cannot be read as equally
    long lists of attribute values (or a single value) side by side.
    """
    combos = df.groupBy(*keys, *attrs).agg(row_count().alias("__part"))
    key = Window.partitionBy(*keys)
    out = combos.withColumn(n, F.sum("__part").over(key))
    if strict:
        fits = F.lit(True)
        for a in attrs:
            distinct = F.size(F.collect_set(F.struct(a)).over(key))
            fits = fits & distinct.isin(F.lit(1), F.count(F.lit(1)).over(key))
        clash = F.raise_error(F.lit("attributes of a station-year have clashing lengths"))
        out = out.withColumn("__fits", fits)
        out = out.withColumn(n, F.when(F.col("__fits"), F.col(n)).otherwise(clash.cast("bigint")))
    return out.select(*keys, *attrs, n)


def site_counts(df: DataFrame, by: list[str] = ("habitat", "ProgramID", "ProgramLocationID")) -> DataFrame:
    return df.groupBy(*by).agg(row_count().alias("N_Data"))


def station_map(df: DataFrame) -> DataFrame:
    """Map table: one row per station and distinct position, from the station-year table.

    Summary and positions come from one aggregate per station: its distinct
    positions are a set beside its years and parameters, which is then unfolded.
    """
    keys = ["ProgramLocationID", "ProgramID", "ProgramName", "Entity"]
    place = ["Lat", "Lon", "Region"]
    cells = df.groupBy(*keys, *place, "Year", "Parameter").agg(F.sum("Data_N").alias("__n"))
    out = cells.groupBy(*keys).agg(
        F.collect_set(F.struct(*place)).alias("__places"),
        sorted_set("Year").alias("years"),
        set_with_null("Parameter").alias("params"),
        na_min("Year").alias("YearMin"),
        na_max("Year").alias("YearMax"),
        F.sum("__n").alias("Data_N"),
    )
    out = out.withColumn("rad", bubble(F.col("Data_N"), 100))
    return out.select("*", F.inline("__places")).drop("__places")


def bubble(n: Column, scale: float) -> Column:
    return F.sqrt(n) / scale


def entity_overview(df: DataFrame, as_of) -> DataFrame:
    """Entity table from the station-year table, largest first when ordered by ``-Data_N``."""
    return df.groupBy("Entity", "link2").agg(
        status_of(na_max("Year"), as_of).alias("Status"),
        distinct_with_null("ProgramLocationID").alias("NumStations"),
        F.sum("Data_N").alias("Data_N"),
        F.array_join(sorted_set("Parameter"), ", ").alias("IncludedParams"),
    )


def station_detail(df: DataFrame, as_of) -> DataFrame:
    """Station by parameter table from the station-year table."""
    return df.groupBy("Entity", "ProgramLocationID", "ProgramName", "link", "Parameter").agg(
        F.sum("Data_N").alias("Data_N"),
        status_of(na_max("Year"), as_of).alias("Status"),
    )


def distinct_per(df: DataFrame, by: list[str], col: str, n: str = "n") -> DataFrame:
    """Number of distinct values of ``col`` per group, a missing value being one."""
    return df.groupBy(*by).agg(distinct_with_null(col).alias(n))


def value_summary(df: DataFrame, by: list[str], value: str = "ResultValue", digits: int = 2) -> DataFrame:
    """Count, rounded mean, minimum and maximum; missing as soon as one value is missing."""
    return df.groupBy(*by).agg(
        row_count().alias("N_samples"),
        round_half_even(na_mean(value), digits).alias("mean"),
        na_min(value).alias("min"),
        na_max(value).alias("max"),
    )


def value_cells(df: DataFrame, keys: list[str], value: str = "ResultValue") -> DataFrame:
    """Observations reduced to their keys, keeping what counts and value summaries need.

    One scan of the observations; every table whose keys are among ``keys``
    follows from the cells.
    """
    return df.groupBy(*keys).agg(
        row_count().alias("n_rows"),
        F.count(value).alias("n_known"),
        F.sum(value).alias("total"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )


def _of_cells(digits: int) -> list[Column]:
    whole = F.sum("n_known") == F.sum("n_rows")
    return [
        F.sum("n_rows").alias("N_samples"),
        round_half_even(F.when(whole, F.sum("total") / F.sum("n_rows")), digits).alias("mean"),
        F.when(whole, F.min("lowest")).alias("min"),
        F.when(whole, F.max("highest")).alias("max"),
    ]


def cell_summary(cells: DataFrame, by: list[str], digits: int = 2) -> DataFrame:
    """``value_summary`` from the cells of the observations."""
    return cells.groupBy(*by).agg(*_of_cells(digits))


def cell_summaries(cells: DataFrame, grains: dict[str, list[str]], grain: str = "grain", digits: int = 2) -> DataFrame:
    """``cell_summary`` at several grains in one scan and one exchange, told apart by ``grain``.

    Key columns that a grain lacks are null there; a null in a key that it has is
    a group of its own, since the grain follows from the grouping and not from nulls.
    """
    keys = list(dict.fromkeys(k for by in grains.values() for k in by))
    out = cells.groupingSets([[F.col(k) for k in by] for by in grains.values()], *keys).agg(
        F.grouping_id().alias("__grouping"), *_of_cells(digits)
    )
    name = None
    for label, by in grains.items():
        bits = sum(1 << i for i, k in enumerate(reversed(keys)) if k not in by)
        name = (F if name is None else name).when(F.col("__grouping") == bits, F.lit(label))
    return out.withColumn(grain, name).drop("__grouping")


def coverage_overview(
    df: DataFrame, by: list[str], station: str = "ProgramLocationID", year: str = "Year", n: str | None = None
) -> DataFrame:
    """Stations, observations, years and period of record per group.

    Two distinct counts make Spark repeat its input once per count, so the
    observations are first reduced to one row per (group, station, year).
    """
    cells = df.groupBy(*by, station, year).agg(row_count(n).alias("__n"))
    return cells.groupBy(*by).agg(
        distinct_with_null(station).alias("Number of Stations"),
        F.sum("__n").alias("Number of Observations"),
        distinct_with_null(year).alias("Years of Data"),
        period_text(na_min(year), na_max(year)).alias("Period of Record"),
    )


def program_areas(df: DataFrame, link_base: str, habitat: str = "Habitat") -> DataFrame:
    """Distinct (habitat, program, area) with label and link."""
    return df.select(habitat, "ProgramID", "ProgramName", "ManagedAreaName").distinct().select(
        "*",
        id_name("ProgramID", "ProgramName").alias("pNameID"),
        detail_link(link_base, "ProgramID").alias("link"),
    )


def location_markers(
    df: DataFrame, out: str = "n_data", n: str | None = None, habitat: str = "Habitat"
) -> DataFrame:
    """Count, years and parameters per habitat and sampling location.

    Reduced to (location, year, parameter) first, so the sets are built from a
    few rows per location and never from raw observations.
    """
    keys = [habitat, "ProgramLocationID", "ProgramID", "ProgramName", "LocationID"]
    cells = df.groupBy(*keys, "Year", "ParameterName").agg(row_count(n).alias("__n"))
    return cells.groupBy(*keys).agg(
        F.sum("__n").alias(out),
        sorted_set("Year").alias("years"),
        set_with_null("ParameterName").alias("params"),
    )


def distinct_points(df: DataFrame, by=("ProgramLocationID", "lat", "lon", "habitat")) -> DataFrame:
    return df.select(*by).distinct()


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def collapse(df: DataFrame, by: list[str], col: str, sep: str = ", ", out: str | None = None) -> DataFrame:
    """Distinct values of ``col`` per group as one sorted text.

    A group's values become one text, so ``col`` should have a bounded number
    of them (parameters, areas), which duplicates do not change.
    """
    values = df.select(*by, F.col(col).alias("__v")).distinct()
    texts = F.transform(F.sort_array(F.collect_list("__v")), lambda v: v.cast("string"))
    return values.groupBy(*by).agg(F.array_join(texts, sep).alias(out or col))


def extent(df: DataFrame, lo: str, hi: str, by: list[str] = ()) -> DataFrame:
    """Smallest ``lo`` and largest ``hi``, over all rows or per group."""
    return df.groupBy(*by).agg(F.min(lo).alias("min_value"), F.max(hi).alias("max_value"))


def all_points(df: DataFrame) -> DataFrame:
    """Located sampling points with observation count and the areas they belong to."""
    keys = ["Habitat", "ProgramID", "ProgramName", "ProgramLocationID", "Region", "lat", "lon"]
    cells = (
        df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy(*keys, "ManagedAreaName")
        .agg(row_count().alias("__n"))
    )
    return cells.groupBy(*keys).agg(
        F.sum("__n").alias("n"), set_with_null("ManagedAreaName").alias("areas")
    )
