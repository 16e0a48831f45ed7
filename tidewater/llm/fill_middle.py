"""Fill-in-the-middle rearrangement of texts, cut at code points found by SWAR words.

A batch's UTF-8 bytes are viewed as 64-bit words.  Arithmetic on whole words
marks each byte that ends a code point (the byte before one that is no
continuation byte), ``bitwise_count`` gives the marks per word, and a search in
their running sum finds the word of the k-th mark.  Byte-wise running sums
inside that word, one multiplication, resolve the place.  So only counts and
byte offsets leave Python; texts are cut and joined by Spark as bytes.

Which form a document takes, and where it is cut, follows from a digest of its
id, so a lost task gives the same rows again.

Defined results: a null text is the empty text; an empty text, or one that holds
a mark, stays plain; a null id counts as the empty id; rows are independent of
each other, so repeated rows and ids give repeated results; an empty table gives
no rows; further columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import U64, flat_bytes, slices, text_or_empty

ONES, HIGH = U64(0x0101010101010101), U64(0x8080808080808080)
SLICE = 4 << 20  # bytes that are marked at once


@dataclass(frozen=True)
class Marks:
    """Texts before the parts.  Each begins with a character that it holds only there, so
    that no mark arises across the border of a part."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


MARKS = Marks()


class Units:
    """Code points of packed UTF-8 bytes."""

    def __init__(self, raw: np.ndarray):
        padded = np.zeros((len(raw) // 8 + 2) * 8, np.uint8)
        padded[: len(raw)] = raw
        words = padded.view("<u8").astype(U64, copy=False)
        begins = (words >> U64(7)) & ~(words >> U64(6)) & ONES ^ ONES  # not 10xxxxxx
        ends = begins >> U64(8)
        ends[:-1] |= begins[1:] << U64(56)
        whole, rest = divmod(len(raw), 8)
        ends[whole] &= (U64(1) << U64(8 * rest)) - U64(1)
        ends[whole + 1 :] = 0
        self.ends = ends
        self.upto = np.cumsum(np.bitwise_count(ends), dtype=np.int64)

    def before(self, offsets: np.ndarray) -> np.ndarray:
        """Code points that end before each byte offset."""
        word = offsets >> 3
        inside = self.ends[word] & ((U64(1) << ((offsets & 7).astype(U64) << U64(3))) - U64(1))
        full = np.where(word > 0, self.upto[word - 1], 0)
        return full + np.bitwise_count(inside)

    def after(self, k: np.ndarray) -> np.ndarray:
        """Byte offset after the k-th code point; 0 for none."""
        word = np.searchsorted(self.upto, k, "left")
        left = (k - np.where(word > 0, self.upto[word - 1], 0)).astype(U64)
        sums = self.ends[word] * ONES  # byte i: marks in bytes 0 to i
        reached = ((sums | HIGH) - left * ONES) & HIGH
        return np.where(k > 0, word * 8 + 9 - np.bitwise_count(reached), 0)


def cuts(texts: pa.Array, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, first cut, second cut, their byte offsets) of each text, the cuts being the
    smaller and the larger of the numbers modulo n + 1."""
    raw, offsets = flat_bytes(texts)
    out = []
    for i, j in slices(offsets, SLICE):
        own = offsets[i : j + 1] - offsets[i]
        units = Units(raw[offsets[i] : offsets[j]])
        seen = units.before(own)
        n = np.diff(seen)
        a, b = one[i:j] % (n + 1), two[i:j] % (n + 1)
        low, high = np.minimum(a, b), np.maximum(a, b)
        at = [np.where(x > 0, units.after(seen[:-1] + x) - own[:-1], 0) for x in (low, high)]
        out.append((n, low, high, *at))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 5


CUTS = "n long, low long, high long, low_byte long, high_byte long"
_CUTS = ["n", "low", "high", "low_byte", "high_byte"]


def cut_places(text: Column, one: Column, two: Column) -> Column:
    """Struct of the columns of ``cuts``."""

    @F.arrow_udf(CUTS)
    def places(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, second in batches:
            found = cuts(texts, first.to_numpy(), second.to_numpy())
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], names=_CUTS)

    return places(text, one, two)


def rearranged(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "1",
    rate: int = 90,
    spm: int = 20,
    marks: Marks = MARKS,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): ``rate`` per cent of the texts are
    rearranged, ``spm`` per cent of those with the suffix first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long")
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), digest.alias("digest"))
    marked = F.lit(False)
    for m in (marks.prefix, marks.suffix, marks.middle):
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | marked | (number(3) % 100 >= rate), "plain")
    form = form.when(number(4) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("id", "text", form.alias("form"), cut_places(F.col("text"), number(1), number(2)).alias("c"))
    raw = F.col("text").cast("binary")
    prefix = F.substring(raw, F.lit(1), F.col("c.low_byte").cast("int"))
    middle = F.substring(raw, (F.col("c.low_byte") + 1).cast("int"), (F.col("c.high_byte") - F.col("c.low_byte")).cast("int"))
    suffix = F.substring(raw, (F.col("c.high_byte") + 1).cast("int"), F.octet_length("text"))
    p, s, m = (F.lit(x).cast("binary") for x in (marks.prefix, marks.suffix, marks.middle))
    output = F.when(F.col("form") == "plain", raw)
    output = output.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
    output = output.otherwise(F.concat(s, suffix, p, prefix, m, middle))
    changed = F.col("form") != "plain"
    return rows.select(
        F.col("id").alias(id_col),
        F.col("c.n").alias("n"),
        "form",
        F.when(changed, F.col("c.low")).alias("prefix_chars"),
        F.when(changed, F.col("c.high") - F.col("c.low")).alias("middle_chars"),
        output.cast("string").alias("output"),
    )


def restored(output: Column, form: Column, marks: Marks = MARKS) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(re.escape(x) for x in (marks.prefix, marks.suffix, marks.middle)))
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
