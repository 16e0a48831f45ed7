"""Missing-value rules of the monitoring tables.

The tables were defined in an environment where a missing value is contagious
in an aggregate, counts as a distinct value, and never satisfies a membership
test.  Spark's defaults differ in each case, so every operator goes through
these helpers instead of calling the plain function.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complete(x: Column | str) -> Column:
    """Aggregate: true when no input of the group is missing."""
    return F.count(as_col(x)) == F.count(F.lit(1))


def na_mean(x: Column | str) -> Column:
    """Mean that is missing as soon as one input is missing."""
    return F.when(complete(x), F.avg(as_col(x)))


def na_min(x: Column | str) -> Column:
    return F.when(complete(x), F.min(as_col(x)))


def na_max(x: Column | str) -> Column:
    return F.when(complete(x), F.max(as_col(x)))


def distinct_with_null(x: Column | str) -> Column:
    """Number of distinct values, where "missing" is one of them."""
    c = as_col(x)
    has_null = F.coalesce(F.max(c.isNull().cast("bigint")), F.lit(0).cast("bigint"))
    return F.count_distinct(c) + has_null


def sorted_set(x: Column | str) -> Column:
    """Distinct values in ascending order; missing values are left out."""
    return F.sort_array(F.collect_set(as_col(x)))


def set_with_null(x: Column | str) -> Column:
    """Distinct values in ascending order, with one trailing null if any was missing."""
    wrapped = F.sort_array(F.collect_set(F.struct(as_col(x).isNull().alias("gap"), as_col(x).alias("v"))))
    return F.transform(wrapped, lambda s: s["v"])


def member(x: Column | str, values: Iterable) -> Column:
    """``x`` is one of ``values``; never null, so ``~member`` keeps missing rows."""
    values = list(values)
    known = [v for v in values if v is not None]
    c = as_col(x)
    hit = F.coalesce(c.isin(known), F.lit(False)) if known else F.lit(False)
    return hit | c.isNull() if len(known) < len(values) else hit


def na_case(*branches: tuple[Column, object], otherwise: object = None) -> Column:
    """Ordered conditions where an unknown condition makes the result missing.

    A plain ``CASE`` falls through to the next branch when a condition is
    null; here the first null condition ends the evaluation with null.
    """
    out = None
    for cond, value in branches:
        out = F.when(cond.isNull(), F.lit(None)) if out is None else out.when(cond.isNull(), F.lit(None))
        out = out.when(cond, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def round_half_even(x: Column, digits: int) -> Column:
    """Round to ``digits`` decimals: the closer neighbour, the even one on a tie.

    Closeness is measured on the stored binary value, so 0.15 goes to 0.1 and
    0.25 to 0.2.  Spark's ``round`` and ``bround`` work on the shortest decimal
    text of the value instead.  Values too large to have decimals stay as they are.
    """
    scale = F.lit(float(10**digits))
    scaled = x * scale
    lower, upper = F.floor(scaled) / scale, F.ceil(scaled) / scale
    below, above = x - lower, upper - x
    even = F.when(F.floor(scaled) % 2 == 0, lower).otherwise(upper)
    rounded = F.when(below < above, lower).when(below > above, upper).otherwise(even)
    return F.when(F.abs(scaled) < float(2**52), rounded).otherwise(x)


def null_safe_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str | tuple[str, str]],
    how: str = "inner",
) -> DataFrame:
    """Equi-join in which a missing key matches a missing key.

    ``on`` holds names, or (left name, right name) pairs; only the left key
    columns survive.  No broadcast is forced: Catalyst and AQE broadcast a side
    when its measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and
    use a (skew-splitting) shuffle join beyond it.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    tmp = {r: f"__join_{i}" for i, (_, r) in enumerate(pairs)}
    renamed = right.withColumnsRenamed(tmp)
    cond = None
    for l, r in pairs:
        eq = left[l].eqNullSafe(renamed[tmp[r]])
        cond = eq if cond is None else cond & eq
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*tmp.values())


def choosing(df: DataFrame, col: str) -> DataFrame:
    """The same rows, by a condition that tells the planner that this side of a join chooses.

    Only a side with a condition of its own makes Spark prune the other side at
    run time, by partition or by Bloom filter.  The value compared is none that a
    key has.
    """
    return df.where(~F.col(col).cast("string").eqNullSafe(F.lit("\x00")))
