"""Removal of repeated byte strings with a family of sparse suffix arrays.

Suffixes that begin at anchors stand for all suffixes: an anchor is the place
of the least GRAM-byte hash among the grams of some SPAN-byte window, so that
every window holds one, chosen by the window's bytes alone.  A batch's suffixes
form an array ordered by the anchor's gram, then by the whole context that
windows around the anchor can reach.  Arrays are dealt to shards by gram; each
shard keeps a logarithmic family of levels: a new batch is merge-scanned with
the level of its own size, the two become one level of twice the size, and so
on.  A merge-scan finds equal neighbours: the later of two suffixes with equal
contexts is covered wholly and leaves the index.

Where one gram occurs in different contexts, only some windows may be repeated.
The first suffix of each such context goes through a second family, which is
ordered by the hash of each of its windows.  Both give the exact answer for
every window; hashes have 64 bits, in addition to the 64 of the gram.

A batch drops what repeats inside it before anything is shuffled, so a string
that fills a third of the corpus reaches a shard once per batch.  There are
SHARDS times ``spark.sql.shuffle.partitions`` shards, and a shard's arrays are
what a task holds.  Only places go back to the texts: they are broadcast when their written
size is below ``common.BROADCAST`` bytes and meet the texts in a shuffle join beyond.

Defined results: a null text is empty; texts shorter than SPAN lose nothing; a
null id takes no part and loses nothing; rows that share an id are one document
(repeated rows do not remove each other, and lose the same places); an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import (
    U64,
    chain,
    flat_bytes,
    materialised,
    mix,
    shuffle_partitions,
    slices,
    text_or_empty,
    when_small,
)

SPAN = 100
GRAM = 32
CHUNK = 1 << 18  # bytes worked on at once
BATCH = 4 << 20  # bytes of text whose suffixes form one batch
WINDOW_BATCH = 1 << 19  # bytes of text whose windows, up to one a byte, form one batch
SHARDS = 4  # shards per shuffle partition

_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
ENTRY = "shard int, resolved boolean, gram binary, context binary, doc binary, place binary"
_ENTRY = pa.schema(
    [("shard", pa.int32()), ("resolved", pa.bool_())] + [(n, pa.binary()) for n in ("gram", "context", "doc", "place")]
)
FOUND = "doc long, covered array<long>, open array<long>"
_FOUND = pa.schema([("doc", pa.int64()), ("covered", pa.list_(pa.int64())), ("open", pa.list_(pa.int64()))])

_TABLES: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _TABLES or len(_TABLES[0]) < n:
        up = np.full(n, _BASE, U64)
        down = np.full(n, pow(_BASE, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _TABLES[:] = [np.cumprod(up), np.cumprod(down)]
    return _TABLES[0], _TABLES[1]


class Hashes:
    """Hashes of any byte range of a chunk, from prefix sums."""

    def __init__(self, raw: np.ndarray):
        up, self.down = power_tables(max(len(raw), CHUNK + 4 * SPAN))
        self.sums = np.zeros(len(raw) + 1, U64)
        np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]


def sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i : i + width] for every whole window, by doubling."""
    reach, out = 1, x
    while reach < width:
        step = min(reach, width - reach)
        out = f(out[:-step], out[step:])
        reach += step
    return out


def pieces(raw: np.ndarray, offsets: np.ndarray, span: int):
    """(bytes, starts of texts or parts, their document numbers, places of the starts
    in the document, first and last+1 window start of each part).

    Short texts go together; a text above CHUNK comes in parts that overlap by
    what the context of an anchor can reach.
    """
    sizes = np.diff(offsets)
    wanted = np.flatnonzero(sizes >= span)
    small = wanted[sizes[wanted] <= CHUNK]
    ends = np.concatenate([[0], np.cumsum(sizes[small])])
    for i, j in slices(ends, CHUNK):
        docs = small[i:j]
        if len(docs):
            flat = np.concatenate([raw[offsets[d] : offsets[d + 1]] for d in docs])
            yield flat, ends[i : j + 1] - ends[i], docs, np.zeros(len(docs), np.int64)
    for d in wanted[sizes[wanted] > CHUNK]:
        for lo in range(0, int(sizes[d]), CHUNK):
            begin, end = max(0, lo - 2 * span), min(int(sizes[d]), lo + CHUNK + 2 * span)
            yield raw[offsets[d] + begin : offsets[d] + end], np.array([0, end - begin]), np.array([d]), np.array([begin])


def anchors(hashes: Hashes, bounds: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the anchors of a chunk of texts that end at ``bounds``."""
    grams = mix(hashes.every(gram))
    key = np.maximum((grams >> U64(32)).astype(np.uint32), np.uint32(1))  # 0 means no window
    window = span - gram + 1
    least = sliding(key, window, np.minimum)  # one per SPAN-byte window of the chunk
    for b in bounds[1:-1]:  # windows across two texts choose nothing
        least[max(b - span + 1, 0) : b] = 0
    # A gram is chosen if it is the least of some window, that is if the greatest of those leasts is its own.
    padded = np.concatenate([np.zeros(window - 1, np.uint32), least, np.zeros(window - 1, np.uint32)])
    best = sliding(padded, window, np.maximum)
    places = np.flatnonzero(best == key)
    places = places[best[places] > 0]
    return places, grams[places]


def entries(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, span: int, gram: int):
    """(gram, context, doc, place) of all anchors of a batch."""
    parts = []
    reach = span - gram
    for flat, bounds, docs, begins in pieces(raw, offsets, span):
        hashes = Hashes(flat)
        places, keys = anchors(hashes, bounds, span, gram)
        own = np.searchsorted(bounds, places, "right") - 1
        left = np.minimum(places - bounds[own], reach)
        right = np.minimum(bounds[own + 1] - places, span)
        context = chain(hashes.of(places - left, places + right), (left * 4096 + right).astype(U64))
        at = places - bounds[own] + begins[own]
        sizes = np.diff(offsets)[docs[own]]
        # Parts of a long text: only anchors whose context is whole.
        whole = (left == np.minimum(at, reach)) & (right == np.minimum(sizes - at, span))
        parts.append((keys[whole], context[whole], ids[docs[own[whole]]], at[whole]))
    if not parts:
        return tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def windows(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, opened: list[np.ndarray], span: int, gram: int):
    """(hash, 0, doc, start) of all windows around the open anchors of each text."""
    parts = []
    reach = span - gram
    for k, at in enumerate(opened):
        n = int(offsets[k + 1] - offsets[k])
        if not len(at) or n < span:
            continue
        at = np.unique(at)
        first = np.maximum(at - reach, 0)
        last = np.minimum(at, n - span)
        starts = np.unique(ranges(first, last + 1))
        text = raw[offsets[k] : offsets[k + 1]]
        for lo in range(0, n, CHUNK):  # long texts in parts
            some = starts[(starts >= lo) & (starts < lo + CHUNK)]
            if len(some):
                hashes = Hashes(text[lo : min(n, lo + CHUNK + span)])
                parts.append((mix(hashes.of(some - lo, some - lo + span)), np.full(len(some), ids[k]), some))
    if not parts:
        return tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64))
    key, doc, start = (np.concatenate(c) for c in zip(*parts, strict=True))
    return key, np.zeros(len(key), U64), doc, start


def ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, one after another."""
    size = np.maximum(end - first, 0)
    begins = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(begins, size) + np.repeat(first, size)


def merge_scan(gram, context, doc, place):
    """Orders suffixes and takes out each that equals an earlier one:
    ((gram, context, doc, place) of the first ones, (doc, place) of the others).

    The stable sort merges its sorted runs, which the inputs are.
    """
    order = np.argsort(gram, kind="stable")
    gram, context, doc, place = gram[order], context[order], doc[order], place[order]
    same = np.zeros(len(gram), bool)
    same[1:] = gram[1:] == gram[:-1]
    tied = same.copy()
    tied[:-1] |= same[1:]
    slots = np.flatnonzero(tied)
    if len(slots):
        inner = slots[np.lexsort((place[slots], doc[slots], context[slots], gram[slots]))]
        context[slots], doc[slots], place[slots] = context[inner], doc[inner], place[inner]
    equal = same
    equal[1:] &= context[1:] == context[:-1]
    # Rows that share an id are one document: the same place is no earlier one.
    if equal.any():
        head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(equal))))
        later = equal & ~((doc == doc[head]) & (place == place[head]))
    else:
        later = equal
    first = ~equal
    return (gram[first], context[first], doc[first], place[first]), (doc[later], place[later])


class IndexFamily:
    """Levels of 1, 2, 4, ... batches; a full level is merged with the one that comes in."""

    def __init__(self):
        self.levels: list[tuple | None] = []
        self.covered: list[tuple[np.ndarray, np.ndarray]] = []

    def _merge(self, a, b):
        out, covered = merge_scan(*[np.concatenate([x, y]) for x, y in zip(a, b, strict=True)])
        if len(covered[0]):
            self.covered.append(covered)
        return out

    def insert(self, batch: tuple) -> None:
        batch, covered = merge_scan(*batch)
        if len(covered[0]):
            self.covered.append(covered)
        for i, level in enumerate(self.levels):
            if level is None:
                self.levels[i] = batch
                return
            batch, self.levels[i] = self._merge(level, batch), None
        self.levels.append(batch)

    def closed(self) -> tuple:
        """The whole index as one level."""
        out = None
        for level in self.levels:
            if level is not None:
                out = level if out is None else self._merge(out, level)
        self.levels = []
        return out if out is not None else tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64))


def ambiguous(index: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(doc, place) of suffixes whose gram has several contexts."""
    gram, _, doc, place = index
    same = np.zeros(len(gram), bool)
    same[1:] = gram[1:] == gram[:-1]
    both = same.copy()
    both[:-1] |= same[1:]
    return doc[both], place[both]


def dealt(batch: tuple, shards: int) -> Iterator[pa.RecordBatch]:
    """A batch's suffix array, without what repeats in it, as one row per shard."""
    (gram, context, doc, place), (old_doc, old_place) = merge_scan(*batch)
    to = (mix(gram) % U64(shards)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(shards + 1))
    rows = []
    for s in range(shards):
        part = order[cuts[s] : cuts[s + 1]]
        if len(part):
            rows.append((s, False, *[c[part].tobytes() for c in (gram, context, doc, place)]))
    if len(old_doc):
        rows.append((int(abs(int(old_doc[0])) % shards), True, b"", b"", old_doc.tobytes(), old_place.tobytes()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRY)], schema=_ENTRY)


def by_document(covered, opened) -> pa.RecordBatch:
    """Places by document: covered ones and open ones."""

    def grouped(pairs):
        doc = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
        place = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
        order = np.lexsort((place, doc))
        return doc[order], place[order]

    doc_c, place_c = grouped(covered)
    doc_o, place_o = grouped(opened)
    docs = np.union1d(doc_c, doc_o)
    lists = []
    for doc, place in ((doc_c, place_c), (doc_o, place_o)):
        cuts = np.append(np.searchsorted(doc, docs), len(doc)).astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(place)))
    return pa.RecordBatch.from_arrays([pa.array(docs), *lists], schema=_FOUND)


def scan_shard(rows: Iterator[pa.RecordBatch], second: bool) -> Iterator[pa.RecordBatch]:
    """One shard: batches enter its family; covered and open places come out."""
    family = IndexFamily()
    for batch in rows:
        for i in range(batch.num_rows):
            c = [np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in ((2, U64), (3, U64), (4, np.int64), (5, np.int64))]
            if batch.column(1)[i].as_py():
                family.covered.append((c[2], c[3]))
            else:
                family.insert(tuple(c))
    index = family.closed()
    opened = [] if second else [ambiguous(index)]
    out = by_document(family.covered, opened)
    for i in range(0, out.num_rows, 10_000):
        yield out.slice(i, 10_000)


def spans_of(covered: list | None, starts: list | None, span: int, gram: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) from covered contexts and repeated windows; ends may pass the text's."""
    a = np.asarray(covered if covered is not None else [], np.int64)
    w = np.asarray(starts if starts is not None else [], np.int64)
    lo = np.concatenate([np.maximum(a - (span - gram), 0), w])
    hi = np.concatenate([a + span, w + span])
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    fresh = np.ones(len(lo), bool)
    fresh[1:] = lo[1:] > hi[:-1]
    begins = np.flatnonzero(fresh)
    ends = hi[np.append(begins[1:], len(lo)) - 1]
    return list(zip(lo[begins].tolist(), ends.tolist(), strict=True))


def _sharded(rows: DataFrame, second: bool) -> DataFrame:
    n = shuffle_partitions(rows.sparkSession) * SHARDS
    return rows.repartitionById(n, F.col("shard")).mapInArrow(lambda it: scan_shard(it, second), FOUND)


def repeated_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM
) -> DataFrame:
    """(id, spans): for each document that loses bytes, the runs (start, end) of
    bytes covered by a string of ``span`` bytes that starts earlier."""
    shards = shuffle_partitions(df.sparkSession) * SHARDS
    docs = df.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    docs = docs.where(F.col("doc").isNotNull() & (F.octet_length("text") >= span))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in slices(offsets, BATCH):
                own = offsets[i : j + 1] - offsets[i]
                yield from dealt(entries(raw[offsets[i] : offsets[j]], own, ids[i:j], span, gram), shards)

    # By document, so that no file is written per shard.
    together = lambda *names: [F.flatten(F.collect_list(c)).alias(c) for c in names]
    found = _sharded(docs.mapInArrow(suffixes, ENTRY), False).groupBy("doc").agg(*together("covered", "open"))
    found = materialised(found, "suffix-found")
    opened = materialised(found.where(F.size("open") > 0).select("doc", "open"), "suffix-open")

    def opened_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat_bytes(batch.column(1))
            ids, at = batch.column(0).to_numpy(), batch.column(2)
            for i, j in slices(offsets, WINDOW_BATCH):
                own = offsets[i : j + 1] - offsets[i]
                opened_at = [v.values.to_numpy() for v in at.slice(i, j - i)]
                yield from dealt(windows(raw[offsets[i] : offsets[j]], own, ids[i:j], opened_at, span, gram), shards)

    some = docs.join(when_small(opened), "doc").select("doc", "text", "open")
    again = _sharded(some.mapInArrow(opened_windows, ENTRY), True)
    places = found.select("doc", "covered", F.array().cast("array<long>").alias("starts")).unionByName(
        again.select("doc", F.array().cast("array<long>").alias("covered"), F.col("covered").alias("starts"))
    )
    gathered = places.groupBy("doc").agg(*together("covered", "starts"))
    # Documents without places have no spans; a filter on the spans would evaluate them twice, in a worker each.
    gathered = gathered.where((F.size("covered") > 0) | (F.size("starts") > 0))

    @F.arrow_udf("array<struct<start:long,end:long>>")
    def merged(covered: pa.Array, starts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        rows = (
            [{"start": a, "end": b} for a, b in spans_of(c.values.to_numpy(), s.values.to_numpy(), span, gram)]
            for c, s in zip(covered, starts, strict=True)
        )
        return pa.array(rows, kind)

    out = gathered.select(F.col("doc").alias(id_col), merged("covered", "starts").alias("spans"))
    return materialised(out, "suffix-spans")


def without(text: Column, spans: Column) -> Column:
    """Bytes of ``text`` (binary) outside the sorted ``spans``; all of them where spans are null."""
    n = F.octet_length(text).cast("long")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(n))
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    return F.when(spans.isNull(), text).otherwise(F.array_join(F.zip_with(begins, ends, cut), "").cast("binary"))


def _inside(text: Column, at: Column) -> Column:
    """Whether a character goes on at this byte of a UTF-8 text."""
    return F.coalesce(F.hex(F.substring(text, (at + 1).cast("int"), F.lit(1))).between("80", "BF"), F.lit(False))


def on_characters(text: Column, span: Column) -> Column:
    """The span without the characters that it covers in part (of four bytes at most)."""
    start, end = span["start"], span["end"]
    ahead, back = F.lit(3), F.lit(3)
    for k in (2, 1, 0):
        ahead = F.when(~_inside(text, start + k), F.lit(k)).otherwise(ahead)
        back = F.when(~_inside(text, end - k), F.lit(k)).otherwise(back)
    return F.struct((start + ahead).alias("start"), F.greatest(start + ahead, end - back).alias("end"))


def deduplicated(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    whole_characters: bool = False,
) -> DataFrame:
    """Every row with ``spans`` (clipped, empty if none) and ``kept`` (binary) beside its columns.

    With ``whole_characters`` a character that a span covers in part stays, so
    that ``kept`` is valid UTF-8.
    """
    found = repeated_spans(df, id_col, text_col, span, gram).select(F.col(id_col).alias("__s_doc"), F.col("spans").alias("__s_spans"))
    out = df.join(when_small(found), F.col(id_col).cast("long") == F.col("__s_doc"), "left").drop("__s_doc")
    text = text_or_empty(text_col).cast("binary")
    n = F.octet_length(text).cast("long")
    clipped = F.transform(
        F.filter("__s_spans", lambda s: s["start"] < n),
        lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], n).alias("end")),
    )
    out = out.withColumn("__s_spans", clipped)
    if whole_characters:
        out = out.withColumn("__s_spans", F.transform("__s_spans", lambda s: on_characters(text, s)))
    spans = F.col("__s_spans")
    return out.select(
        *df.columns,
        F.coalesce(spans, F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        without(text, spans).alias("kept"),
    )
