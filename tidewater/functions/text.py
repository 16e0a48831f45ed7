"""Text building: labels, links, buttons, number and period texts, splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.semantics import as_col, round_half_even


def paste(*parts: Column | str, sep: str = "") -> Column:
    """Concatenate; a ``str`` is literal text, a missing value reads ``NA`` and a
    whole floating-point number reads without decimals."""

    def cell(p: Column) -> Column:
        # The type is known when the plan is made, so only one branch stays in it.
        number = F.typeof(p).isin("double", "float")
        return F.when(number, number_text(p.try_cast("double"))).otherwise(p.cast("string"))

    cells = [F.lit(p) if isinstance(p, str) else F.coalesce(cell(p), F.lit("NA")) for p in parts]
    return F.concat_ws(sep, *cells) if sep else F.concat(*cells)


def list_text(values: Column, sep: str = ", ") -> Column:
    """Array as text, missing elements as ``NA``."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), sep, "NA")


def number_text(x: Column) -> Column:
    """Decimal number as text without a trailing ``.0`` and without a minus zero."""
    plain = F.regexp_replace((x + F.lit(0.0)).cast("string"), r"\.0$", "")
    # From here on a double's own text has an exponent.
    large = F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    return F.when((F.abs(x) >= 1e7) & (F.abs(x) < 1e27), large).otherwise(plain)


def thousands(x: Column | str) -> Column:
    return F.format_number(as_col(x), 0)


def period_text(lo: Column, hi: Column) -> Column:
    return paste(lo, " - ", hi)


def interval_text(lo: Column, hi: Column, digits: int = 2) -> Column:
    return paste(number_text(round_half_even(lo, digits)), " to ", number_text(round_half_even(hi, digits)))


def id_name(id_: Column | str, name: Column | str) -> Column:
    return paste(as_col(id_), " - ", as_col(name))


def detail_link(base: str, id_: Column | str) -> Column:
    """Address of a details page; ``base`` is configuration."""
    return paste(base, as_col(id_))


def anchor(href: Column, label: Column) -> Column:
    return paste("<a href='", href, "' target='_blank'>", label, "</a>")


def linked_name(href: Column, label: Column) -> Column:
    """Anchor when there is an address, the bare label otherwise."""
    return F.when(href.isNotNull(), anchor(href, label)).otherwise(label)


def years_label(parameter: Column, n_years: Column) -> Column:
    return paste(parameter, " (", n_years, ")")


def button(prefix: str, parameter: Column, station: Column, label: Column) -> Column:
    """Clickable label whose id carries the parameter and the station."""
    return paste("<a id='", prefix, "_", parameter, "_", station, "' href='#'>", label, "</a>")


def axis_label(parameter: Column, unit: Column, unit_only: str = "pH") -> Column:
    """``parameter (unit)``, or the unit alone for the unit-less parameter."""
    return F.when(parameter == unit_only, unit).otherwise(paste(parameter, " (", unit, ")"))


def short_names(x: Column, replacements: list[tuple[str, str]]) -> Column:
    """Apply literal replacements one after the other."""
    for long, short in replacements:
        x = F.replace(x, F.lit(long), F.lit(short))
    return x


def without_blanks(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit(""))


def id_part(x: Column, index: int, parts: int, sep: str = "_") -> Column:
    """Part ``index`` (from 0) of a composed id; the last part keeps its separators."""
    return F.get(F.split(x, sep, parts), F.lit(index))


def file_token(path: Column, index: int, sep: str = "_") -> Column:
    """Token ``index`` (from 0) of the base name of a path, null when absent."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.get(F.split(base, sep), F.lit(index))


def labelled(pairs: list[tuple[str, Column]]) -> Column:
    """Pop-up text: one line per (label, value)."""
    parts: list[Column | str] = []
    for label, value in pairs:
        parts += [f"<br> {label}: ", value]
    return paste(*parts)
