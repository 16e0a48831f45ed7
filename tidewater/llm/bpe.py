"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts are cut at places where a match of the pre-split pattern always ends, so
that a long text goes through the library in short pieces with the same result.
Ids leave the operator packed (little-endian unsigned 32-bit), the layout in
which token files are stored; ``unpack_ids`` gives an array column.  Results
leave the worker in parts, so that it holds the batch that Spark sent and the
ids of few texts beside it, however many rows a batch has.

Defined results: a null text encodes as the empty text, which has no tokens and
no bytes; null ids decode to null; rows are independent of each other, so
repeated rows and ids give repeated results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import flat_bytes, slices, text_or_empty

PART = 2 << 20  # bytes of texts or ids whose results are held at once, one row at least
PIECE = 20_000  # characters that go to the library at once, where a safe boundary exists
RUN = 2_000  # white space runs from this length on are encoded apart from the pattern

# Between a character that is no white space and one that is, every match ends;
# a letter or digit followed by something of another kind ends a match as well.
SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")
LONG_SPACE = regex.compile(rf"\p{{White_Space}}{{{RUN},}}")

_ENCODERS: dict[tuple[int, str], tiktoken.Encoding] = {}


def read_ranks(path: str) -> bytes:
    """Contents of a rank file; its size is that of the vocabulary, not of the data."""
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    key = (hash(ranks), pattern)
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _ENCODERS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """Parts of a text at safe boundaries; longer than ``most`` only where none exists."""
    start = 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if not cut or cut.start() <= start:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def split_runs(text: str) -> Iterator[tuple[bool, str]]:
    """(is one match, part): long white space runs, which the library's pattern
    engine cannot take, become the matches that the pattern would give."""
    start = 0
    for run in LONG_SPACE.finditer(text):
        # The run's last character belongs to what follows: as its leading blank or as a match of its own.
        stop = run.end() if run.end() == len(text) else run.end() - 1
        yield False, text[start : run.start()]
        yield True, text[run.start() : stop]
        start = stop
    yield False, text[start:]


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for whole, part in split_runs(text):
        if whole:
            ids += enc._encode_single_piece(part)
        else:
            for piece in pieces(part):
                ids += enc.encode_ordinary(piece)
    return ids


def parts(batches: Iterator[pa.Array], most: int = PART) -> Iterator[pa.Array]:
    """The rows of text or binary batches in parts of at most ``most`` bytes, one row at least."""
    for batch in batches:
        if len(batch):
            for i, j in slices(flat_bytes(batch)[1], most):
                yield batch.slice(i, j - i)


def packed(enc: tiktoken.Encoding, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(number of tokens, packed ids) of texts without nulls."""
    sizes, ids = [], []
    for value in texts:
        row = np.asarray(encode_text(enc, value.as_py()), "<u4")
        sizes.append(len(row))
        ids.append(row.tobytes())
    return pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())


def unpacked(enc: tiktoken.Encoding, ids: pa.Array) -> pa.Array:
    out = [None if not v.is_valid else enc.decode_bytes(np.frombuffer(v.as_buffer(), "<u4").tolist()) for v in ids]
    return pa.array(out, pa.binary())


def coded(enc: tiktoken.Encoding, batches: Iterator[pa.Array], back: bool = False) -> Iterator[pa.Array]:
    """Structs of ``n_tokens`` and ``ids``; with ``back`` also ``decoded``, the bytes of those ids."""
    for texts in parts(batches):
        sizes, ids = packed(enc, texts)
        if back:
            yield pa.StructArray.from_arrays([sizes, ids, unpacked(enc, ids)], ["n_tokens", "ids", "decoded"])
        else:
            yield pa.StructArray.from_arrays([sizes, ids], ["n_tokens", "ids"])


def encode(spark: SparkSession, ranks_path: str, pattern: str, text: str | Column) -> Column:
    """Struct of ``n_tokens`` (long) and ``ids`` (binary, packed) for a text column."""
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("n_tokens long, ids binary")
    def encoding(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from coded(encoder(ranks.value, pattern), batches)

    return encoding(text_or_empty(text))


def decode(spark: SparkSession, ranks_path: str, pattern: str, ids: str | Column) -> Column:
    """Bytes of packed ids; they need not be valid UTF-8, so no text is made of them."""
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("binary")
    def decoding(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(ranks.value, pattern)
        for part in parts(batches):
            yield unpacked(enc, part)

    return decoding(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(spark: SparkSession, ranks_path: str, pattern: str, text: str | Column) -> Column:
    """Struct of ``n_tokens``, ``ids`` and ``decoded`` (the bytes of those ids) for a text column.

    Both ways share a worker; ``decode`` of what ``encode`` gives takes two for
    each running task, and sends all ids to the second one.
    """
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("n_tokens long, ids binary, decoded binary")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from coded(encoder(ranks.value, pattern), batches, back=True)

    return both(text_or_empty(text))


def unpack_ids(ids: str | Column) -> Column:
    """Packed ids as an array of long."""
    hexed = F.hex(ids)
    byte = lambda i, k: F.substring(hexed, i * 8 + 1 + 2 * k, F.lit(2))
    number = lambda i: F.conv(F.concat(byte(i, 3), byte(i, 2), byte(i, 1), byte(i, 0)), 16, 10).cast("long")
    n = (F.octet_length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).otherwise(F.array().cast("array<long>"))


def encoded(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, ids) for every row."""
    out = df.select(F.col(id_col), encode(df.sparkSession, ranks_path, pattern, text_col).alias("encoded"))
    return out.select(id_col, "encoded.n_tokens", "encoded.ids")
