"""Helpers shared by the text operators: shared folders, columns and packed words."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.scratch import scratch_path

U64 = np.uint64
# White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, label: str) -> str:
    """New folder name below the shared folder of ``spark.checkpoint.dir``.

    Only a purely local session (one process) may do without that option; it
    then gets a temporary folder, its options staying as they are.  Elsewhere a missing
    option is an error.
    """
    return scratch_path(spark, label)


def materialised(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST = 32 << 20  # written bytes up to which a table may be sent to every executor


def when_small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its files are at most BROADCAST bytes
    together; beyond that the planner chooses, normally a shuffle join."""
    files = df.inputFiles()
    if not files:
        return df
    size = df.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    return F.broadcast(df) if size is not None and size <= BROADCAST else df


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors: once per context, as a zip that Spark hands out."""
    context = spark.sparkContext
    if getattr(context, "_tidewater_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, f"{package.name}/{path.relative_to(package)}")
    target = Path(tempfile.mkdtemp(prefix="tidewater-zip-")) / "tidewater_package.zip"
    target.write_bytes(packed.getvalue())
    context.addPyFile(str(target))
    context._tidewater_shipped = True


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lowered(col: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does that for texts of ASCII characters, and faster."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- packed bytes -----------------------------------------------------------


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without nulls, one copy at most."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offs = offs.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    return out


def slices(offsets: np.ndarray, most: int):
    """Row ranges (i, j) of at most ``most`` bytes each, always one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


_SEP = np.zeros(256, bool)
_SEP[list(SPACE_BYTES)] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts): words of all texts in order, and words per text."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    inside = ~_SEP[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, U64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes; equal words have equal hashes."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    total = int(lengths.sum())
    begins = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(begins, lengths)
    values = raw[place + np.repeat(starts, lengths)].astype(U64) + U64(1)
    values *= powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, begins))


def chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes; the order matters."""
    return mix(first * U64(0x9FB21C651E98DF25) + second)
