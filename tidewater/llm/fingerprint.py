"""Locality-sensitive document fingerprints: a quartile bucket digest.

All byte triplets of a text, with two boundary bytes at either end, are hashed
into BUCKETS buckets and counted.  The digest holds for each bucket in which
quartile of the text's own counts it lies (two bits), and a code of the text's
length.  Two digests compare by a bounded difference score: the mean difference
of the quartiles over the one that digests with the same shares of quartiles have
when they are unrelated, plus a bounded term for the lengths; the likeness is one
less the difference, between 0 and 1.

``beside_next`` compares each document with its edited text, whose end is
replaced by the beginning of the next document, and with that next document.
Documents are sorted by ranges of ids, each range is one pass over its rows in
order, and only the first and last text of each range are matched afterwards, so
no task sees more than its range.

Defined results: a null text is the empty text, which has a digest of its own;
equal texts have equal digests; a null id comes first; rows that share an id
follow each other in the order of a hash of their texts; a single row is its own
next document; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import materialised, shuffle_partitions, text_or_empty

BUCKETS = 256
BOUNDARY = 0xFF  # no byte of UTF-8
LENGTH_STEPS = 8  # length codes per doubling
LENGTH_WEIGHT, LENGTH_MOST = 0.25, 32  # share and code difference at which the length term ends
SLICE = 1 << 20


def digests(texts: list[bytes]) -> np.ndarray:
    """Digest of each text, a row of bytes each."""
    out = np.zeros((len(texts), BUCKETS // 4 + 2), np.uint8)
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= SLICE):
            held += len(texts[j])
            j += 1
        out[i:j] = _digests(texts[i:j])
        i = j
    return out


def _digests(texts: list[bytes]) -> np.ndarray:
    edge = bytes([BOUNDARY, BOUNDARY])
    raw = np.frombuffer(edge + edge.join(texts) + edge, np.uint8).astype(np.uint32)
    value = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    value *= np.uint32(0x9E3779B1)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x85EBCA77)
    lengths = np.array([len(t) for t in texts], np.int64)
    bucket = (value >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
    bucket += np.repeat(np.arange(len(texts)) * BUCKETS, lengths + 2)
    counts = np.bincount(bucket, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
    limits = [k * BUCKETS // 4 - 1 for k in (1, 2, 3)]
    quartiles = np.partition(counts, limits, axis=1)[:, limits]
    codes = (counts[:, :, None] > quartiles[:, None, :]).sum(axis=2).astype(np.uint8).reshape(len(texts), -1, 4)
    size = np.rint(LENGTH_STEPS * np.log2(1 + lengths)).astype(np.uint16)
    packed = codes[:, :, 0] << 6 | codes[:, :, 1] << 4 | codes[:, :, 2] << 2 | codes[:, :, 3]
    return np.concatenate([packed, (size >> 8).astype(np.uint8)[:, None], (size & 255).astype(np.uint8)[:, None]], axis=1)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of digests, row by row."""
    quartile = lambda x: (x[:, :-2, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).astype(np.int64)
    length = lambda x: x[:, -2].astype(np.int64) << 8 | x[:, -1]
    qa, qb = (quartile(x).reshape(len(x), BUCKETS) for x in (a, b))
    # Cumulative shares of the quartiles; what they give for digests that are unrelated otherwise.
    under = lambda q: (q[:, :, None] < np.array([1, 2, 3])).mean(axis=1)
    ua, ub = under(qa), under(qb)
    unrelated = (ua * (1 - ub) + ub * (1 - ua)).sum(axis=1)
    apart = np.abs(qa - qb).mean(axis=1) / np.maximum(unrelated, 1 / BUCKETS)
    apart += LENGTH_WEIGHT * np.minimum(np.abs(length(a) - length(b)), LENGTH_MOST) / LENGTH_MOST
    return 1 - np.minimum(apart, 1)


def digest(text: str | Column) -> Column:
    """Fingerprint of a text column, in hexadecimal."""

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = digests([t.as_buffer().to_pybytes() for t in batch])
            yield pa.array([r.tobytes() for r in rows], pa.binary())

    return F.lower(F.hex(packed(text_or_empty(text))))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints in hexadecimal; null if one is null."""

    @F.arrow_udf("double")
    def compared(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            rows = [np.frombuffer(b"".join(v.as_buffer() for v in c), np.uint8).reshape(len(c), -1) for c in (x, y)]
            yield pa.array(alike(*rows) if len(x) else np.zeros(0), pa.float64())

    blank = F.lit(bytes(BUCKETS // 4 + 2))
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, compared(F.coalesce(F.unhex(a), blank), F.coalesce(F.unhex(b), blank)))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_ROW = [
    ("id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.binary()),
    ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]
ROW = "id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
RANGE = f"{ROW}, edge string, part int, text string"


def pair_rows(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of ROW for texts and the ones that follow them."""
    made = [edited(a, b).encode() for a, b in zip(texts, following)]
    own = digests([t.encode() for t in texts])
    chained = len(texts) and all(a is b for a, b in zip(texts[1:], following))
    later = (
        np.concatenate([own[1:], digests([following[-1].encode()])]) if chained else digests([t.encode() for t in following])
    )
    changed = digests(made)
    columns = [
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(t).digest() for t in made],
        [r.tobytes() for r in own],
        [r.tobytes() for r in changed],
        alike(own, changed),
        alike(own, later),
    ]
    return [pa.array(c, kind) for c, (_, kind) in zip(columns, _ROW)]


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range of ids, in order: all but the last with their digests; the first
    and the last with their texts, to be matched with the neighbouring ranges."""
    names = [n for n, _ in _ROW]

    def edge(kind: str, row_id, text: str, part: int) -> pa.RecordBatch:
        columns = [pa.array([row_id if n == "id" else None], t) for n, t in _ROW]
        columns += [pa.array([kind]), pa.array([part], pa.int32()), pa.array([text], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "edge", "part", "text"])

    held: tuple | None = None
    part = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if held is None:
            part = batch.column(2)[0].as_py()
            yield edge("first", ids[0], texts[0], part)
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = (ids[-1], texts[-1])
        i = 0
        while i < len(ids) - 1:
            j, size = i, 0
            while j < len(ids) - 1 and (j == i or size + len(texts[j]) <= SLICE):
                size += len(texts[j])
                j += 1
            columns = pair_rows(ids[i:j], texts[i:j], texts[i + 1 : j + 1])
            columns += [pa.nulls(j - i, pa.string()), pa.array([part] * (j - i), pa.int32()), pa.nulls(j - i, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "edge", "part", "text"])
            i = j
    if held is not None:
        yield edge("last", *held, part)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROW of (id, text, following), one row at a time: these are the last texts of ranges."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = [batch.column(c)[k].as_py() for c in range(3)]
            yield pa.RecordBatch.from_arrays(pair_rows([row[0]], [row[1]], [row[2]]), names=[n for n, _ in _ROW])


def beside_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next),
    the next document being that of the next id, and the first one for the last."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    order = [F.col("id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = rows.select("id", "text", F.spark_partition_id().alias("part"))
    rows = materialised(rows.mapInArrow(ranges, RANGE), "fingerprint-rows")
    first = rows.where("edge = 'first'").select("part", "text")
    # One row per range, without texts.
    parts = first.select("part")
    after = F.lead("part").over(Window.orderBy("part"))
    parts = parts.select("part", F.coalesce(after, F.min("part").over(Window.partitionBy())).alias("following"))
    last = rows.where("edge = 'last'").select("id", "text", "part").join(parts, "part")
    last = last.join(first.toDF("following", "following_text"), "following").select("id", "text", "following_text")
    names = [n for n, _ in _ROW]
    out = rows.where("edge is null").select(*names).unionByName(last.mapInArrow(joined, ROW))
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select(
        F.col("id").alias(id_col),
        "n_chars",
        hexed("edited_sha256"),
        hexed("fingerprint"),
        hexed("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
