"""Row gates, fills, overrides and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.semantics import choosing, member, null_safe_join


def quality_gate(df: DataFrame, flags: dict[str, object] | None = None) -> DataFrame:
    """Keep rows whose flag columns have the required values (pushed to the scan)."""
    for name, value in (flags or {"Include": 1, "MADup": 1}).items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def keep(df: DataFrame, col: str, values) -> DataFrame:
    """Rows whose ``col`` is in a list, or in the only column of a DataFrame."""
    if isinstance(values, DataFrame):
        return null_safe_join(df, choosing(values, values.columns[0]), [(col, values.columns[0])], "left_semi")
    return df.where(member(col, values))


def exclude(df: DataFrame, col: str, values) -> DataFrame:
    """Rows whose ``col`` is not listed; rows with a missing ``col`` stay."""
    if isinstance(values, DataFrame):
        return null_safe_join(df, values, [(col, values.columns[0])], "left_anti")
    return df.where(~member(col, values))


def fill(df: DataFrame, col: str, source: Column | str) -> DataFrame:
    source = F.col(source) if isinstance(source, str) else source
    return df.withColumn(col, F.coalesce(F.col(col), source))


def overwrite(df: DataFrame, col: str, where: Column, value: Column) -> DataFrame:
    """Replace ``col`` on the rows where the condition is true, unknown counts as false."""
    return df.withColumn(col, F.when(where, value).otherwise(F.col(col)))


def apply_overrides(df: DataFrame, overrides: DataFrame, on: list[str]) -> DataFrame:
    """Pin columns to given values on every row of the listed keys.

    Columns of ``overrides`` other than ``on`` replace the same column of
    ``df``; a null there leaves the row as it is.  One row per key is made so
    that the join cannot multiply rows; values that clash for a key are an error.
    """
    pinned = [c for c in overrides.columns if c not in on]

    def only(c: str) -> Column:
        clash = F.raise_error(F.lit(f"overrides of {c} clash")).cast(overrides.schema[c].dataType)
        return F.when(F.min(c).eqNullSafe(F.max(c)), F.max(c)).otherwise(clash)

    once = overrides.groupBy(*on).agg(*[only(c).alias(f"__pin_{c}") for c in pinned])
    out = null_safe_join(df, once, on, "left")
    cols = [F.coalesce(f"__pin_{c}", c).alias(c) if c in pinned else F.col(f"`{c}`") for c in df.columns]
    return out.select(*cols)


def view(df: DataFrame, rename: dict[str, str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Columns to show: with ``rename``, exactly those, in that order."""
    df = df.drop(*(drop or []))
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in rename.items()]) if rename else df


def union_strict(*dfs: DataFrame) -> DataFrame:
    """Union of tables that must have the same columns."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_loose(*dfs: DataFrame) -> DataFrame:
    """Union of tables; a column that one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def backfill(current: DataFrame, archived: DataFrame, key: str, values) -> DataFrame:
    """Current rows plus the archived rows of the chosen keys."""
    return union_loose(current, keep(archived, key, values))


def ordered(df: DataFrame, by: list[str]) -> DataFrame:
    """Sort with missing values last; a leading ``-`` means descending."""
    return df.orderBy(
        *[F.col(b[1:]).desc_nulls_last() if b.startswith("-") else F.col(b).asc_nulls_last() for b in by]
    )


def category_rank(col: str, first: list[str]) -> Column:
    """Sort rank with the ``first`` categories leading, all others sharing the next rank.

    Order by (rank, category); no global window is needed.
    """
    position = F.array_position(F.array(*[F.lit(v) for v in first]), F.col(col))
    return F.when(position > 0, position).otherwise(len(first) + 1).cast("int")


def entity_order(df: DataFrame, col: str, first: list[str], reverse: bool = False) -> DataFrame:
    rank = category_rank(col, first)
    return df.orderBy(rank.desc(), F.col(col).desc()) if reverse else df.orderBy(rank, F.col(col))
