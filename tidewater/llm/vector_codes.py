"""Compression of vectors to codes of one byte per part, with codebooks from dual-tree Lloyd rounds.

A vector's components become integers; the vector is cut into equal consecutive
parts, each with its own codebook.  A round assigns every part to the nearest
entry of its codebook and replaces each entry by the floored mean of its parts.
All of it is integer arithmetic, so results do not depend on how rows are dealt.

Within a batch of rows, a balanced tree over the parts (bounding boxes, counts
and cached sums) meets a balanced tree over the entries.  The two descend
together: an entry node whose least distance to a node of parts exceeds the
smallest greatest distance is pruned, ties staying.  Where one entry is left the
whole node is assigned by its cached sum; leaves that stay uncertain compute
integer distances to what is left, the lower index winning ties.

A task adds its batches up and emits one row per part, entry and component that
it met, so a round shuffles a bounded number of rows per task, and the driver
sees the codebooks only, whose size is a parameter.

Defined results: rows whose vector is null or empty, holds a null or non-finite
component, or has another length than the kept vector of the smallest id are
left out; rows that share an id are rows of their own, in the order of their
components where the first entries are chosen; a null id comes last; null labels
are one label; a table without kept vectors gives no rows; a component beyond
LIMIT after scaling is an error, as is a length that the parts do not divide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import materialised, when_small

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LIMIT = 1 << 27  # squared distances of parts up to 64 components wide then fit 64 bits
LEAF = 8  # parts in a leaf
BATCH = 2048  # rows under one tree


class Tree:
    """Balanced trees over points (trees, n, width), one beside the other, all of one shape."""

    def __init__(self, points: np.ndarray, leaf: int):
        trees, n, _ = points.shape
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        full = leaf << self.depth
        # The last point fills up, without weight.
        order = np.tile(np.minimum(np.arange(full), n - 1), (trees, 1))
        weight = np.tile(np.arange(full) < n, (trees, 1))
        rows = np.arange(trees)[:, None]
        for level in range(self.depth):
            nodes, size = trees << level, full >> level
            own = points[rows, order].reshape(nodes, size, -1)
            axis = (own.max(axis=1) - own.min(axis=1)).argmax(axis=1)
            value = own[np.arange(nodes)[:, None], np.arange(size), axis[:, None]]
            by = np.argpartition(value, size // 2, axis=1)
            order = np.take_along_axis(order.reshape(nodes, size), by, 1).reshape(trees, full)
            weight = np.take_along_axis(weight.reshape(nodes, size), by, 1).reshape(trees, full)
        self.order, self.weight = order, weight
        self.sorted = points[rows, order]
        cut = self.sorted.reshape(trees, full // leaf, leaf, -1)
        heavy = weight.reshape(trees, full // leaf, leaf)
        # Levels from the leaves up: boxes, counts and cached sums of each node.
        self.low, self.high = [cut.min(axis=2)], [cut.max(axis=2)]
        self.count, self.total = [heavy.sum(axis=2)], [(cut * heavy[..., None]).sum(axis=2)]
        for _ in range(self.depth):
            pairs = lambda x: x.reshape(trees, x.shape[1] // 2, 2, *x.shape[2:])
            self.low.append(pairs(self.low[-1]).min(axis=2))
            self.high.append(pairs(self.high[-1]).max(axis=2))
            self.count.append(pairs(self.count[-1]).sum(axis=2))
            self.total.append(pairs(self.total[-1]).sum(axis=2))
        for levels in (self.low, self.high, self.count, self.total):
            levels.reverse()


def bounds(low, high, entry_low, entry_high) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distances between boxes."""
    gap = np.maximum(np.maximum(entry_low - high, low - entry_high), 0)
    span = np.maximum(entry_high - low, high - entry_low)
    return (gap * gap).sum(axis=-1), (span * span).sum(axis=-1)


def pruned(points: Tree, books: Tree, level: int, entry_level: int, part, node, entry) -> np.ndarray:
    """Which pairs of nodes, sorted by part and node, may still hold a nearest entry."""
    least, most = bounds(
        points.low[level][part, node],
        points.high[level][part, node],
        books.low[entry_level][part, entry],
        books.high[entry_level][part, entry],
    )
    first = starts(part, node)
    limit = np.minimum.reduceat(most, first)
    return least <= np.repeat(limit, np.diff(np.append(first, len(part))))


def starts(part: np.ndarray, node: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (node[1:] != node[:-1])))


def halves(x: np.ndarray) -> np.ndarray:
    return (2 * x[:, None] + np.arange(2)).ravel()


class Assignment:
    """Nearest entries of all points of one batch, with counts and sums per entry."""

    def __init__(self, points: np.ndarray, books: np.ndarray):
        """``points``: (parts, n, width); ``books``: (parts, entries, width), integers."""
        self.points, self.books = Tree(points, LEAF), Tree(books, 1)
        parts, entries, width = books.shape
        self.codes = np.zeros(self.points.order.shape, np.int64)
        self.count = np.zeros((parts, entries), np.int64)
        self.total = np.zeros((parts, entries, width), np.int64)
        self.whole = 0  # points assigned with their node
        self._descend()

    def _descend(self) -> None:
        points, books = self.points, self.books
        part = np.arange(len(points.order))
        node = entry = np.zeros(len(part), np.int64)
        level = entry_level = 0
        while True:
            if entry_level < books.depth:
                entry_level += 1
                part, node, entry = np.repeat(part, 2), np.repeat(node, 2), halves(entry)
                keep = pruned(points, books, level, entry_level, part, node, entry)
                part, node, entry = part[keep], node[keep], entry[keep]
            if entry_level == books.depth:
                part, node, entry = self._settle(level, part, node, entry)
                if not len(part) or level == points.depth:
                    break
            if level < points.depth:
                level += 1
                first = starts(part, node)
                size = np.diff(np.append(first, len(part)))
                # Both children of a node take all of its entries, one child after the other.
                twice = np.repeat(size, 2)
                begin = np.cumsum(twice) - twice
                at = np.arange(2 * len(part)) - np.repeat(begin, twice) + np.repeat(np.repeat(first, 2), twice)
                side = np.repeat(np.tile([0, 1], len(first)), twice)
                part, node, entry = part[at], 2 * node[at] + side, entry[at]
                keep = pruned(points, books, level, entry_level, part, node, entry)
                part, node, entry = part[keep], node[keep], entry[keep]
        self._leaves(part, node, entry)

    def _settle(self, level, part, node, entry):
        """Assign nodes with one entry left as a whole; the pairs of the others."""
        first = starts(part, node) if len(part) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(part)))
        one = first[size == 1]
        p, m, e = part[one], node[one], self.books.order[part[one], entry[one]]
        n = self.points.count[level][p, m]
        np.add.at(self.count, (p, e), n)
        np.add.at(self.total, (p, e), self.points.total[level][p, m])
        self.whole += int(n.sum())
        view = self.codes.reshape(len(self.codes), len(self.points.low[level][0]), -1)
        view[p, m] = e[:, None]
        many = np.repeat(size > 1, size)
        return part[many], node[many], entry[many]

    def _leaves(self, part, node, entry) -> None:
        """Integer distances of the points in uncertain leaves to the entries left."""
        if not len(part):
            return
        points = self.points
        cut = points.sorted.reshape(len(points.sorted), -1, LEAF, points.sorted.shape[2])
        index = self.books.order[part, entry]
        by = np.lexsort((index, node, part))
        part, node, entry, index = part[by], node[by], entry[by], index[by]
        apart = np.zeros((len(part), LEAF), np.int64)
        for k in range(cut.shape[3]):
            step = cut[part, node, :, k] - self.books.sorted[part, entry, k][:, None]
            apart += step * step
        first = starts(part, node)
        size = np.diff(np.append(first, len(part)))
        best = np.minimum.reduceat(apart, first, axis=0)
        nearest = np.where(apart == np.repeat(best, size, axis=0), index[:, None], np.iinfo(np.int64).max)
        nearest = np.minimum.reduceat(nearest, first, axis=0)
        p, m = part[first], node[first]
        self.codes.reshape(len(self.codes), -1, LEAF)[p, m] = nearest
        weight = points.weight.reshape(len(points.weight), -1, LEAF)[p, m]
        np.add.at(self.count, (p[:, None], nearest), weight)
        np.add.at(self.total, (p[:, None], nearest), cut[p, m] * weight[..., None])

    def in_order(self, n: int) -> np.ndarray:
        """(parts, n) entries of the points as they came."""
        out = np.zeros((len(self.codes), n), np.int64)
        rows, slots = np.nonzero(self.points.weight)
        out[rows, self.points.order[rows, slots]] = self.codes[rows, slots]
        return out


def parted(column: pa.Array, parts: int) -> np.ndarray:
    """(parts, n, width) of a list column whose lists are of one length."""
    flat = column.flatten().to_numpy().astype(np.int64)
    return np.ascontiguousarray(flat.reshape(len(column), parts, -1).transpose(1, 0, 2))


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, BATCH):
        yield batch.slice(i, BATCH)


def entry_sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, entry, place, n, total) of all rows of a task."""
    count = np.zeros(books.shape[:2], np.int64)
    total = np.zeros(books.shape, np.int64)
    for batch in batches:
        for rows in chunks(batch):
            got = Assignment(parted(rows.column(0), len(books)), books)
            count += got.count
            total += got.total
    part, entry = np.nonzero(count)
    width = books.shape[2]
    columns = [
        np.repeat(part, width),
        np.repeat(entry, width),
        np.tile(np.arange(width), len(part)),
        np.repeat(count[part, entry], width),
        total[part, entry].ravel(),
    ]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "n", "total"])


def codes_of(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, label, code, error) from (id, label, vector)."""
    for batch in batches:
        for rows in chunks(batch):
            points = parted(rows.column(2), len(books))
            codes = Assignment(points, books).in_order(rows.num_rows)
            step = points - books[np.arange(len(books))[:, None], codes]
            error = (step * step).sum(axis=(0, 2))
            packed = np.ascontiguousarray(codes.T.astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(error)],
                names=["id", "label", "code", "error"],
            )


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vector) of the valid rows as integers, written once."""
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))
    scaled = lambda x: F.floor(x.cast("double") * scale)
    fits = lambda x: F.abs(x.cast("double") * scale) < LIMIT
    whole = lambda x: F.when(fits(x), scaled(x).cast("int")).otherwise(F.raise_error(F.lit("vector component out of range")))
    vector = F.col(vector_col)
    rows = df.where(vector.isNotNull() & (F.size(vector) > 0)).where(F.forall(vector, finite))
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(vector, whole).alias("vector"))
    return materialised(rows, "codes-vectors")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def learned(vectors: DataFrame, parts: int, entries: int, rounds: int) -> tuple[DataFrame, np.ndarray | None]:
    """(rows of the common length, codebooks); None without rows."""
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    least = vectors.orderBy(*order).limit(1).collect()
    if not least:
        return vectors, None
    width = len(least[0]["vector"])
    if width % parts:
        raise ValueError(f"{parts} equal parts of vectors of length {width}")
    rows = vectors.where(F.size("vector") == width)
    first = rows.orderBy(*order).limit(entries).collect()  # as many as a codebook has entries
    books = np.array([r["vector"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        now = books
        sums = rows.select("vector").mapInArrow(
            lambda it: entry_sums(it, now), "part long, entry long, place long, n long, total long"
        )
        sums = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = now.copy()
        for r in sums.collect():  # one row per component of the codebooks
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return rows, books


def coded(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of the kept rows; ``code`` is packed,
    one byte per part."""
    if entries > 256:
        raise ValueError("a code of one byte tells at most 256 entries apart")
    vectors = kept_vectors(df, id_col, vector_col, label_col, scale)
    rows, books = learned(vectors, parts, entries, rounds)
    kinds = [df.schema[c].dataType for c in (id_col, label_col)]
    schema = T.StructType(
        [
            T.StructField("id", kinds[0]),
            T.StructField("label", kinds[1]),
            T.StructField("code", T.BinaryType()),
            T.StructField("error", T.LongType()),
        ]
    )
    if books is None:
        out = rows.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        out = rows.mapInArrow(lambda it: codes_of(it, books), schema)
    out = materialised(out, "codes-rows")
    sums = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    sums = when_small(materialised(sums, "codes-labels"))
    out = out.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(
        F.col("id").alias(id_col),
        "code",
        "error",
        "label_error",
        F.lit(None if books is None else digest(books)).cast("string").alias("codebooks_sha256"),
    )
