"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

A document's set is its distinct shingles; equal sets are one class, told by a
128-bit digest, and its smallest id stands for it.  Each class has a signature:
the minwise token of each of COORDINATES bins (one permutation, empty bins
filled from other bins, each in its own fixed order).

A tree branches recursively.  A node picks one or two coordinates from its own
hash, on average one over the similarity asked for, and each document goes to
the child of its minwise token there.  So two documents of that similarity are
expected to stay together on one path however deep the tree goes.  Nodes of at
most SMALL documents are compared exhaustively; the others branch again.
Independent trees are repeated until a linked pair is missed with a probability
below about 1e-4.

Large nodes first make groups in linear work: the documents of a large node of
the first LEAD_TREES trees are dealt to chunks of about CHUNK, in which each one
is paired with its most similar predecessor.  The components of the confirmed
pairs are labels; documents of one label need no comparison, since the result is
components.  A node that holds one label ends there, which keeps a group of
thousands of near copies linear.  Mixed large nodes branch until comparing them
in blocks, pair by pair, sends a document to COPIES blocks on average, or until
ROUNDS steps were made: the greatest depth is FIRST_LEVELS + STEP * ROUNDS = 11
levels, where a pair at the threshold of 85 per cent is missed with a probability
of 8.1e-5 (``missed``).  Larger nodes at that depth are compared exactly, at a
cost that is quadratic in their documents without the most frequent label.

A pair that comes up is emitted once: by the first tree that compares it for
certain, which follows from its signatures, the trees in which either document
lies in a large node, and the depth that the join went to.

Comparisons in nodes use set sizes and signatures, with a margin of SIGMAS
standard deviations (LEAST_MARGIN at least for tiny sets); each surviving pair is
confirmed on the full sets.
Components follow by hooking and pointer jumping on the confirmed links.

Defined results: texts without words have empty sets and are linked with
nothing; a null id is linked with nothing, has no component and is kept; rows
that share an id are judged by their own texts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import (
    U64,
    chain,
    flat_bytes,
    lower_ascii,
    materialised,
    mix,
    shuffle_partitions,
    slices,
    text_or_empty,
    when_small,
    word_hashes,
    word_spans,
)

WORDS = 5
PERCENT = 85
COORDINATES = 256
TREES = 24
FIRST_LEVELS = 3  # levels branched before nodes are counted
SMALL = 64
STEP = 2  # levels that large nodes branch before they are counted again
ROUNDS = 4  # of such steps at most; what is still large then is compared whole, in blocks
BLOCK = 1024  # documents of a large node that are compared at once with as many others
COPIES = 2  # blocks that a document of a large node may be sent to on average instead of branching on
LEAD_TREES = 4  # trees whose large nodes pair documents with predecessors first
CHUNK = 512
SIGMAS = 4.5
TINY = 64  # shingles of a union up to which the margin is LEAST_MARGIN at least
LEAST_MARGIN = 0.25
SLICE = 1 << 19  # bytes of text hashed at once, at some forty times their size
PART = 1 << 18  # shingles whose sets leave a worker at once, one set at least

PRINTS = "id long, carried string, n_shingles long, d1 long, d2 long, signature binary"
_PRINTS = ["id", "carried", "n_shingles", "d1", "d2", "signature"]


def shingles(text: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, offsets = flat_bytes(text)
    for i, j in slices(offsets, SLICE):
        own = lower_ascii(raw[offsets[i] : offsets[j]])
        starts, ends, counts = word_spans(own, offsets[i : j + 1] - offsets[i])
        hashes = word_hashes(own, starts, ends)
        gram = hashes
        for k in range(1, words):
            gram = chain(gram[: len(gram) - 1], hashes[k:]) if len(gram) > 1 else gram[:0]
        at = np.cumsum(counts) - counts
        for k, n in enumerate(counts.tolist()):
            if n == 0:
                yield np.zeros(0, U64)
            elif n < words:  # the whole sequence is the one shingle
                whole = hashes[at[k] : at[k] + 1]
                for h in hashes[at[k] + 1 : at[k] + n]:
                    whole = chain(whole, np.array([h]))
                yield mix(whole + U64(n))
            else:
                yield np.unique(gram[at[k] : at[k] + n - words + 1])


def _probes() -> np.ndarray:
    """Bins that an empty bin (a column) takes its token from, the first filled one counts;
    a permutation per bin, so that each own bin of a set fills as many others on average."""
    bins = np.tile(np.arange(COORDINATES)[:, None], COORDINATES)
    return np.random.default_rng(20240229).permuted(bins, axis=0)


def signature_rows(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens (8 bits each) of each set, a row per set."""
    return full_rows(sets)[:, :COORDINATES]


def full_rows(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens of each set and, packed, which bins hold a shingle of their own."""
    out = np.zeros((len(sets), COORDINATES), np.uint8)
    filled = np.zeros((len(sets), COORDINATES), bool)
    shift = U64(64 - COORDINATES.bit_length() + 1)
    for row, s in enumerate(sets):
        if len(s):
            bins = (s >> shift).astype(np.int64)
            first = np.ones(len(s), bool)
            first[1:] = bins[1:] != bins[:-1]
            out[row, bins[first]] = (s[first] & U64(255)).astype(np.uint8)
            filled[row, bins[first]] = True
    occupied = np.packbits(filled, axis=1)
    left = np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1))
    own, values, full = filled[left], out[left], filled[left]
    for k, probe in enumerate(_probes()):
        take = ~full & own[:, probe]
        values[take] = values[:, probe][take]
        full |= take
        if k % 8 == 7:  # only sets with empty bins go on
            done = full.all(axis=1)
            out[left[done]] = values[done]
            left, own, values, full = left[~done], own[~done], values[~done], full[~done]
            if not len(left):
                break
    return np.concatenate([out, occupied], axis=1)


def first_digest(s: np.ndarray) -> np.uint64:
    return np.add.reduce(mix(s))


def set_parts(text: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(row of the first, sets) of all texts in order, in parts that hold PART shingles or 1000 sets."""
    done, held, sets = 0, 0, []
    for s in shingles(text, words):
        if sets and (len(sets) >= 1000 or held + len(s) > PART):
            yield done, sets
            done, held, sets = done + len(sets), 0, []
        sets.append(s)
        held += len(s)
    if sets:
        yield done, sets


def prints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """PRINTS of (id, text, carried)."""
    for batch in batches:
        for done, sets in set_parts(batch.column(1), words):
            n = len(sets)
            rows = full_rows(sets)
            d1 = np.array([first_digest(s) for s in sets], U64)
            d2 = np.array([np.add.reduce(mix(s ^ U64(0x5851F42D4C957F2D))) for s in sets], U64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(done, n),
                    batch.column(2).slice(done, n),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(d1.view(np.int64)),
                    pa.array(d2.view(np.int64)),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ],
                names=_PRINTS,
            )


def full_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(id, set) of (id, text, d1), where the text's set has that digest."""
    for batch in batches:
        for done, sets in set_parts(batch.column(1), words):
            d1 = np.array([first_digest(s) for s in sets], U64).view(np.int64)
            own = pa.array(d1 == batch.column(2).slice(done, len(sets)).to_numpy())
            rows = [batch.column(0).slice(done, len(sets)), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, names=["id", "set"]).filter(own)


def signatures(column: pa.Array) -> np.ndarray:
    """Rows of tokens, followed by the packed marks of occupied bins."""
    raw, _ = flat_bytes(column)
    return raw.reshape(-1, COORDINATES + COORDINATES // 8)


def children(nodes: np.ndarray, rows: np.ndarray, sig: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """One level: (child nodes, rows).  A node's coordinates follow from its hash."""
    return shared_children(nodes, rows, sig, sig, percent)


def shared_children(nodes, rows, sig, other, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """One level: (child nodes, rows) where the rows of two tables of signatures go together."""
    one, two = mix(nodes + U64(1)), mix(nodes + U64(2))
    # Expected coordinates per node: 100 / percent.
    twice = (two >> U64(32)) % U64(percent) < U64(100 - percent)
    out_n, out_r = [], []
    for pick, some in ((one, np.ones(len(nodes), bool)), (two, twice)):
        pick, own = pick[some], rows[some]
        at = (pick % U64(COORDINATES)).astype(np.int64)
        token = sig[own, at]
        if other is not sig:
            both = token == other[own, at]
            pick, own, at, token = pick[both], own[both], at[both], token[both]
        out_n.append(chain(pick, (at.astype(U64) << U64(8)) | token.astype(U64)))
        out_r.append(own)
    return np.concatenate(out_n), np.concatenate(out_r)


NODES = "tree int, node long, id long, n long"
_NODES = ["tree", "node", "id", "n"]


def tree_root(tree: int) -> np.ndarray:
    return mix(np.array([tree + 1], U64))


def roots(batches: Iterator[pa.RecordBatch], trees: int, levels: int, percent: int) -> Iterator[pa.RecordBatch]:
    """NODES after the first levels of every tree, from (id, n, signature)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            ids, n = part.column(0).to_numpy(), part.column(1).to_numpy()
            sig = signatures(part.column(2))
            for tree in range(trees):
                rows = np.arange(len(ids))
                nodes = np.full(len(ids), tree_root(tree)[0])
                for _ in range(levels):
                    nodes, rows = children(nodes, rows, sig, percent)
                columns = [np.full(len(rows), tree, np.int32), nodes.view(np.int64), ids[rows], n[rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NODES)


def descended(batches: Iterator[pa.RecordBatch], percent: int, levels: int) -> Iterator[pa.RecordBatch]:
    """NODES after further levels, from NODES with signatures."""
    for batch in batches:
        if batch.num_rows:
            sig = signatures(batch.column(4))
            nodes, rows = batch.column(1).to_numpy().view(U64), np.arange(batch.num_rows)
            for _ in range(levels):
                nodes, rows = children(nodes, rows, sig, percent)
            tree, ids, n = (batch.column(k).to_numpy()[rows] for k in (0, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (tree, nodes.view(np.int64), ids, n)], names=_NODES)


def first_shared(sig_a, sig_b, mask_a, mask_b, trees: int, levels: int, deepest: int, percent: int) -> np.ndarray:
    """First tree in which each pair is compared for certain; -1 without one.

    That is a tree in which it shares a node after the first levels that is small,
    because one of the two documents lies in no large node there, or a node of the
    greatest depth that the join went to, where everything left is compared.
    """
    out = np.full(len(sig_a), -1)
    for tree in range(trees):
        rows = np.flatnonzero(out < 0)
        if not len(rows):
            break
        nodes = np.full(len(rows), tree_root(tree)[0])
        for _ in range(levels):
            nodes, rows = shared_children(nodes, rows, sig_a, sig_b, percent)
        small = (mask_a[rows] & mask_b[rows]) >> tree & 1 == 0
        out[rows[small]] = tree
        nodes, rows = nodes[~small], rows[~small]
        for _ in range(deepest - levels):
            nodes, rows = shared_children(nodes, rows, sig_a, sig_b, percent)
        out[rows] = tree
    return out


def missed(percent: int, trees: int, levels: int) -> float:
    """Probability that a pair at the similarity shares no node of any tree after so many
    levels, over the agreements that its signatures may have."""
    p, twice = percent / 100, (100 - percent) / percent
    out = 0.0
    for equal in range(COORDINATES + 1):
        a = (equal + (COORDINATES - equal) / 256) / COORDINATES  # tokens of 8 bits may agree by chance
        apart = 0.0
        for _ in range(levels):
            one = 1 - a + a * apart
            apart = one * (1 - twice + twice * one)
        out += comb(COORDINATES, equal) * p**equal * (1 - p) ** (COORDINATES - equal) * apart**trees
    return out


def similar(n_a, n_b, sig_a, sig_b, percent: int) -> np.ndarray:
    """Pairs that sizes and signatures allow to reach the similarity.

    Of the bins that either set occupies, those with the same token in both are a
    sample of the union without replacement: small sets are nearly counted.
    """
    ok = np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * percent
    at = np.flatnonzero(ok)
    p = percent / 100
    for i in range(0, len(at), 20_000):
        part = at[i : i + 20_000]
        a, b = sig_a[part], sig_b[part]
        mark_a, mark_b = a[:, COORDINATES:], b[:, COORDINATES:]
        either = np.bitwise_count(mark_a | mark_b).sum(axis=1, dtype=np.int64)
        both = np.unpackbits(mark_a & mark_b, axis=1).view(bool)
        equal = ((a[:, :COORDINATES] == b[:, :COORDINATES]) & both).sum(axis=1)
        union = (n_a[part] + n_b[part]) / (1 + p)
        margin = SIGMAS * np.sqrt(p * (1 - p) * np.maximum(1 / either - 1 / union, 0))
        margin = np.where(union <= TINY, np.maximum(margin, LEAST_MARGIN), margin)
        ok[part] = equal >= (p - margin) * either
    return ok


def deviation(percent: int) -> float:
    """Standard deviation of the agreement of signatures at the similarity."""
    p = percent / 100
    return (p * (1 - p) / COORDINATES) ** 0.5


def node_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole nodes from rows that are sorted by their first column, the node."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        nodes = table.column(0).to_numpy()
        if not len(nodes):
            continue
        cut = int(np.searchsorted(nodes, nodes[-1], "left"))  # the last node may go on
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest


def pair_batch(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    if len(pairs):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def parents(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of each document with the most similar one of smaller id in its chunk, if
    that is likely to reach the similarity, from (chunk, id, n, signature) sorted by chunk."""
    for table in node_groups(batches):
        chunk, ids, n = (table.column(k).to_numpy() for k in range(3))
        sig = signatures(table.column(3).combine_chunks())
        cuts = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk))
        child, parent = [], []
        for i, j in zip(cuts[:-1], cuts[1:]):
            by = i + np.argsort(ids[i:j], kind="stable")
            for k in range(1, j - i):
                before, own = by[:k], by[k]
                agree = (sig[before, :COORDINATES] == sig[own, :COORDINATES]).mean(axis=1)
                agree[(np.minimum(n[before], n[own]) * 100 < np.maximum(n[before], n[own]) * percent) | (ids[before] == ids[own])] = 0
                best = int(agree.argmax())
                if agree[best] >= percent / 100 - deviation(percent):
                    child.append(ids[own])
                    parent.append(ids[before[best]])
        if child:
            yield from pair_batch(np.array(parent), np.array(child))


def node_pairs(batches: Iterator[pa.RecordBatch], percent: int, trees: int, deepest: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), a < b, that may be similar, from rows (node, tree, id, n, block, label,
    mask, signature) sorted by node.

    Rows of a node compare with each other unless their ``block`` is the same number from
    0 on (sides of a block that comes in two parts).  A pair counts in the first tree that
    surely compares it, or wherever it meets if there is none.
    """
    for table in node_groups(batches):
        nodes, tree, ids, n, block, label, mask = (table.column(k).to_numpy() for k in range(7))
        sig = signatures(table.column(7).combine_chunks())
        cuts = np.append(np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1])), len(nodes))
        size = np.repeat(np.diff(cuts), np.diff(cuts))
        place = np.arange(len(nodes)) - np.repeat(cuts[:-1], np.diff(cuts))
        found_a, found_b = [], []
        for step in range(1, int(size.max())):
            a = np.flatnonzero(place + step < size)
            b = a + step
            keep = (ids[a] != ids[b]) & (label[a] != label[b]) & ((block[a] < 0) | (block[a] != block[b]))
            a, b = a[keep], b[keep]
            ok = similar(n[a], n[b], sig[a], sig[b], percent)
            found_a.append(a[ok])
            found_b.append(b[ok])
        if found_a:
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            for i in range(0, len(a), 20_000):
                x, y = a[i : i + 20_000], b[i : i + 20_000]
                first = first_shared(sig[x], sig[y], mask[x], mask[y], trees, FIRST_LEVELS, deepest, percent)
                here = (first < 0) | (first == tree[x])
                yield from pair_batch(ids[x[here]], ids[y[here]])


def confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose full sets reach the similarity, from (a, b, set_a, set_b)."""
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), "<u8") for k in (2, 3))
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(both) - common))
        if keep:
            yield batch.select(["a", "b"]).filter(pa.array(keep))


class Join:
    """The similarity join over one table of documents."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, words: int, percent: int, trees: int, carry: str | None = None):
        self.words, self.percent, self.trees = words, percent, trees
        self.spark = df.sparkSession
        self.docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
        carried = F.lit(None) if carry is None else F.col(carry)
        rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), carried.cast("string").alias("carried"))
        self.prints = materialised(rows.mapInArrow(lambda it: prints(it, words), PRINTS), "near-prints")
        usable = self.prints.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
        classes = usable.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("id", "signature")).alias("x"))
        classes = classes.select("d1", "d2", F.col("n_shingles").alias("n"), F.col("x.id").alias("doc"), "x.signature")
        classes = materialised(classes, "near-classes")
        # A class goes by its smallest id.  Where rows of different texts share that id, a hash
        # takes its place, and the results get the smallest ids of their components at the end.
        shared = classes.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc")
        shared = materialised(shared, "near-shared")
        self.shared = not shared.isEmpty()
        if self.shared:
            held = when_small(shared).withColumn("held", F.lit(True))
            classes = classes.join(held, "doc", "left").withColumn("id", F.when(F.col("held"), F.xxhash64("d1", "d2", "n")).otherwise(F.col("doc")))
            classes = materialised(classes.drop("held"), "near-classes")
        else:
            classes = classes.withColumn("id", F.col("doc"))
        self.classes = classes

    def with_sets(self, ids: DataFrame) -> DataFrame:
        """(id, set) of the written ids of classes, from the texts."""
        words = self.words
        asked = self.classes.select("id", "doc", "d1").join(ids, "id")
        asked = materialised(asked, "near-asked")
        texts = self.docs.withColumnRenamed("id", "doc").join(when_small(asked), "doc")
        sets = texts.select("id", "text", "d1").mapInArrow(lambda it: full_sets(it, words), "id long, set binary")
        return materialised(sets.distinct(), "near-sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Confirmed ones of the written pairs."""
        percent = self.percent
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        sets = self.with_sets(materialised(ids, "near-ids"))
        left, right = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b")
        return materialised(both.mapInArrow(lambda it: confirmed(it, percent), "a long, b long"), "near-links")

    def groups(self, large: DataFrame) -> DataFrame:
        """Confirmed links of documents in large nodes with similar ones of their chunk, (a, b)."""
        percent = self.percent
        chunks = F.ceil(F.col("size") / CHUNK).cast("long")
        rows = large.where(F.col("tree") < LEAD_TREES)
        rows = rows.select(F.xxhash64("node", F.pmod(F.xxhash64("id"), chunks)).alias("chunk"), "id", "n")
        rows = rows.join(self.classes.select("id", "signature"), "id").select("chunk", "id", "n", "signature")
        rows = rows.repartition(shuffle_partitions(self.spark), "chunk").sortWithinPartitions("chunk")
        pairs = rows.mapInArrow(lambda it: parents(it, percent), "a long, b long").distinct()
        return self.links(materialised(pairs, "near-parents"))

    def all_links(self) -> DataFrame:
        """Links that connect everything that is linked: (a, b)."""
        percent, trees = self.percent, self.trees
        n = shuffle_partitions(self.spark)
        known = self.classes.select("id", "n", "signature")
        rows = known.mapInArrow(lambda it: roots(it, trees, FIRST_LEVELS, percent), NODES)
        rows = materialised(rows, "near-rows")
        # What comparisons ask of a document: its label and the trees in which it lies in a large node.
        known = known.select("id", "signature", F.col("id").alias("label"), F.lit(0).cast("long").alias("mask"))
        links = None
        compared: list[DataFrame] = []
        for step in range(ROUNDS + 1):
            sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
            counted = materialised(rows.join(sizes, "node"), "near-nodes")
            own = counted.where(F.col("size") <= SMALL).select("node", "tree", "id", "n")
            compared.append(own.withColumn("block", F.lit(-1).cast("long")))
            large = counted.where(F.col("size") > SMALL)
            if large.isEmpty():
                break
            if links is None:
                links = self.groups(large)
                label = components(links).toDF("id", "label")
                mask = large.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("mask"))
                known = known.select("id", "signature").join(label, "id", "left").join(mask, "id", "left")
                known = known.select(
                    "id", "signature", F.coalesce("label", "id").alias("label"), F.coalesce("mask", F.lit(0).cast("long")).alias("mask")
                )
                known = materialised(known, "near-known")
            labelled = large.join(known.select("id", "label"), "id")
            left = materialised(self.mixed(labelled), "near-mixed")
            copies = left.agg(F.avg("size") / BLOCK).first()[0]
            if copies is None:  # every large node holds one label
                break
            if copies <= COPIES or step == ROUNDS:
                compared.append(blocks(left))
                break
            below = left.join(known.select("id", "signature"), "id").select("tree", "node", "id", "n", "signature")
            rows = below.mapInArrow(lambda it: descended(it, percent, STEP), NODES)
            rows = materialised(rows, "near-rows")
        every = reduce(DataFrame.unionByName, compared)
        every = every.join(known, "id").select("node", "tree", "id", "n", "block", "label", "mask", "signature")
        every = every.repartition(n, "node").sortWithinPartitions("node")
        deepest = FIRST_LEVELS + STEP * step
        pairs = every.mapInArrow(lambda it: node_pairs(it, percent, trees, deepest), "a long, b long").distinct()
        found = self.links(materialised(pairs, "near-pairs"))
        return found if links is None else found.union(links).distinct()

    def mixed(self, large: DataFrame) -> DataFrame:
        """Rows of large nodes with more than one label, with the node's most frequent label
        as ``major`` and the number of its documents of that label: ``n_major``."""
        per = large.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
        per = per.groupBy("node").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("size"))
        per = per.where("top.c < size").select("node", F.col("top.label").alias("major"), F.col("top.c").alias("n_major"))
        return large.join(per, "node").select("tree", "node", "id", "n", "size", "label", "major", "n_major")


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of mixed nodes dealt to units of at most two blocks of about BLOCK documents, so
    that any two documents meet in one unit unless both have the most frequent label:
    (node, tree, id, n, block).

    Documents of that label meet each block of the others; the others meet each
    block of that label, and each block of their own kind.
    """
    long = lambda x: x.cast("long")
    zero = F.lit(0).cast("long")
    major = F.col("label") == F.col("major")
    count = lambda x: F.greatest(long(F.ceil(x / BLOCK)), F.lit(1).cast("long"))
    n_of, n_other = count(F.col("n_major")), count(F.col("size") - F.col("n_major"))
    own = F.pmod(F.xxhash64("id"), F.when(major, n_of).otherwise(n_other))
    unit = lambda kind, x, y, side: F.struct(
        F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), long(side).alias("block")
    )
    across = F.sequence(zero, F.when(major, n_other).otherwise(n_of) - 1)
    across = F.transform(
        across, lambda k: unit("across", F.when(major, F.col("k")).otherwise(k), F.when(major, k).otherwise(F.col("k")), F.when(major, 0).otherwise(1))
    )
    # Within its own block a document meets every other one: side -1.
    side = lambda k: F.when(F.col("k") == k, F.lit(-1)).when(F.col("k") < k, F.lit(0)).otherwise(F.lit(1))
    within = F.transform(F.sequence(zero, n_other - 1), lambda k: unit("within", F.least("k", k), F.greatest("k", k), side(k)))
    units = F.when(major, across).otherwise(F.concat(across, within))
    out = rows.withColumn("k", own).withColumn("u", F.explode(units))
    return out.select(
        F.xxhash64("node", "u.kind", "u.x", "u.y").alias("node"), "tree", "id", "n", F.col("u.block").alias("block")
    )


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all linked ids: the smallest id that can be reached."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = materialised(edges.union(edges.select("v", "u")), "near-edges")
    comp = materialised(edges.groupBy(F.col("u").alias("id")).agg(F.min(F.least("u", "v")).alias("component")), "near-comp")
    while True:
        near = edges.join(comp.toDF("v", "there"), "v").groupBy(F.col("u").alias("id")).agg(F.min("there").alias("there"))
        hooked = comp.join(near, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "there").alias("component")
        )
        # The component's own id may know a smaller one by now.
        jump = hooked.select(F.col("id").alias("of"), F.col("component").alias("further"))
        new = hooked.join(jump, F.col("component") == F.col("of"), "left")
        new = materialised(
            new.select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "near-comp"
        )
        comp = new.select("id", "component")
        if new.where("old <> component").isEmpty():
            return comp


def grouped(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    trees: int = TREES,
    carry: str | None = None,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row, and its column ``carry`` as text if named."""
    join = Join(df, id_col, text_col, words, percent, trees, carry)
    comp = components(join.all_links()).toDF("rep", "component")
    named = join.classes.select("d1", "d2", F.col("n").alias("n_shingles"), F.col("id").alias("rep"), "doc")
    if join.shared:
        least = comp.join(named, "rep").groupBy("component").agg(F.min("doc").alias("least"))
        comp = comp.join(least, "component").select("rep", F.col("least").alias("component"))
    named = named.join(comp, "rep", "left").withColumn("component", F.coalesce("component", "doc")).drop("doc")
    out = join.prints.select("id", "carried", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
        *([] if carry is None else [F.col("carried").alias(carry)]),
    )
