"""Language-model scoring with a weighted backoff automaton over words.

N-grams seen in training are the automaton's states and arcs.  An arc carries
the smoothed log-probability of a word after a context; where a context has no
arc for the next word, its failure arc leads to the context without its first
word and costs the context's backoff weight.  A text is scored in one traversal
from left to right that carries the state and adds the weights it passes.

    P(w)   = (c(w) + 1) / (N + V + 1)
    P(w|h) = (1 - b) c(hw) / c(h) + b P(w|h')

b, the weight of the failure arc, is the share of n-grams of that length that
occurred once among all that occurred, which estimates how often a context
meets a word it has not been seen with.  With one class for all unseen words
each distribution sums to one.

The model grows with the corpus and is nowhere whole.  Documents are dealt to
buckets of some BUCKET_BYTES, whatever the number of shuffle partitions; a bucket
sends its distinct n-grams (hashes and training counts, as packed arrays) to
shards by hash, nothing where it has none; a shard adds up and answers each
bucket with the counts of what it asked for; the totals of a length, one row
each, are added up beside that and broadcast; a bucket builds the part of the
automaton that its texts can reach and traverses it.  A frequent word is one
entry per bucket, so no shard is hot, and a bucket sends at most a row per
distinct n-gram.  All of it is one Spark plan, in which the exchanges of the
documents and of the requests are used twice each.

Defined results: a null text has only the end token; a null id belongs to the
training part; repeated rows count as often as they occur and, being equal in id
and text, share a bucket; a text longer than BUCKET_BYTES is a bucket of its own
size; without training rows every token has probability one by the base and the
model; an empty table gives no rows.
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
    lower_ascii,
    shuffle_partitions,
    slices,
    text_or_empty,
    word_hashes,
    word_spans,
)

BEGIN, END = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)  # marks before the first and after the last word
SLICE = 4 << 20  # bytes tokenised at once
BUCKET_BYTES = 4 << 20  # text of a bucket, on average
SHARD_BYTES = 32 << 20  # text per shard and n-gram length, on average
SHARDS = 64  # shards of small inputs

REQUEST = "shard int, bucket int, length int, keys binary, counts binary"
_REQUEST = pa.schema(
    [("shard", pa.int32()), ("bucket", pa.int32()), ("length", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
)
ANSWER = "bucket int, shard int, length int, low binary, place binary, high binary"
_ANSWER = pa.schema(
    [("bucket", pa.int32()), ("shard", pa.int32()), ("length", pa.int32())]
    + [(n, pa.binary()) for n in ("low", "place", "high")]
)
TOTAL = "length int, tokens long, types long, once long"
_TOTAL = pa.schema([("length", pa.int32())] + [(n, pa.int64()) for n in ("tokens", "types", "once")])


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts with END after each, tokens per text)."""
    raw, offsets = flat_bytes(text)
    parts, sizes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, j in slices(offsets, SLICE):
        own = lower_ascii(raw[offsets[i] : offsets[j]])
        starts, ends, counts = word_spans(own, offsets[i : j + 1] - offsets[i])
        out = np.full(len(starts) + (j - i), END, U64)
        at = np.arange(len(starts)) + np.repeat(np.arange(j - i), counts)
        out[at] = word_hashes(own, starts, ends)
        parts.append(out)
        sizes.append(counts + 1)
    return np.concatenate(parts), np.concatenate(sizes)


def ngrams(words: np.ndarray, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For lengths 1 to ``order``: (keys of the n-grams that end at each token, whether
    there is one).  A text's first context is BEGIN, and no n-gram reaches before it."""
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(words)) - np.repeat(begins, sizes)
    out = [(words, np.ones(len(words), bool))]
    for length in range(2, order + 1):
        before = np.empty_like(words)  # key of the n-gram one shorter that ends at the token before
        before[1:] = out[-1][0][:-1]
        if length == 2 and len(words):
            before[begins] = BEGIN
        has = place >= length - 2
        out.append((np.where(has, chain(before, words) + U64(length), U64(0)), has))
    return out


def shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the sorted keys of each shard begin; shards are ranges of keys."""
    edges = [(s << 64) // shards for s in range(1, shards)]
    inner = np.searchsorted(keys, np.array(edges, U64))
    return np.concatenate([[0], inner, [len(keys)]])


def packed_keys(keys: np.ndarray) -> bytes:
    """Bytes of sorted keys plane by plane: the first planes repeat and compress well."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(">u8").reshape(-1).astype(U64)


def requests(bucket: int, words, sizes, train, order: int, shards: int) -> Iterator[pa.RecordBatch]:
    """A bucket's distinct n-grams with their counts in its training texts."""
    learned = np.repeat(train, sizes)
    for length, (keys, has) in enumerate(ngrams(words, sizes, order), 1):
        keys, weight = keys[has], learned[has]
        if length == 1 and order > 1:  # the first context is a state as well
            keys = np.append(keys, np.full(len(sizes), BEGIN))
            weight = np.append(weight, train)
        every = np.unique(keys)
        own, counts = np.unique(keys[weight], return_counts=True)
        total = np.zeros(len(every), np.uint32)
        total[np.searchsorted(every, own)] = counts
        cuts = shard_cuts(every, shards)
        filled = np.flatnonzero(np.diff(cuts)).tolist() or [0]  # without n-grams, an empty slice asks for the totals
        rows = [
            (s, bucket, length, packed_keys(every[cuts[s] : cuts[s + 1]]), total[cuts[s] : cuts[s + 1]].tobytes())
            for s in filled
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _REQUEST)], schema=_REQUEST)


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The requests of one shard and length after the other, from rows sorted by both."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and (held[0][0], held[0][2]) != (row[0], row[2]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def added(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys of a shard's requests, their total counts, for each key asked the place in these)."""
    keys = np.concatenate([unpacked_keys(r[3]) for r in rows])
    counts = np.concatenate([np.frombuffer(r[4], np.uint32) for r in rows])
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    begins = np.flatnonzero(fresh)
    total = np.add.reduceat(counts[order].astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64)
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(fresh) - 1
    return keys[order][begins], total, of


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each n-gram, given back to all that asked."""
    for rows in by_shard(batches):
        _, total, of = added(rows)
        at = 0
        for i in range(0, len(rows), 500):
            out = []
            for shard, bucket, length, _, asked in rows[i : i + 500]:
                n = len(asked) // 4
                found = total[of[at : at + n]]
                at += n
                high = np.flatnonzero(found > 254)
                low = np.minimum(found, 255).astype(np.uint8)
                out.append((bucket, shard, length, low.tobytes(), high.astype(np.uint32).tobytes(), found[high].tobytes()))
            part = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, _ANSWER)], schema=_ANSWER)


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's share of the totals of a length: tokens learned from, distinct ones, ones that occurred once."""
    out: dict[int, list[int]] = {}
    for rows in by_shard(batches):
        length = rows[0][2]
        keys, total, _ = added(rows)
        word = total if length > 1 else total[keys != BEGIN]  # BEGIN is a context and no token
        own = out.setdefault(length, [0, 0, 0])
        for k, n in enumerate((word.sum(), (word > 0).sum(), (word == 1).sum())):
            own[k] += int(n)
    if out:
        part = list(zip(*[(length, *own) for length, own in out.items()]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, _TOTAL)], schema=_TOTAL)


class Automaton:
    """The part of the model that a bucket's texts can reach.

    ``weight[m][i]`` is the log10 weight of the arc that token i takes from a
    state of m words, NaN where there is none; ``state[m][i]`` tells whether
    the last m words up to token i are a state; ``fail[m]`` is the log10 weight
    of the failure arcs of states of m words.
    """

    def __init__(self, words, sizes, order: int, counts: dict[int, np.ndarray], totals: dict[int, tuple[int, int, int]]):
        self.order = order
        n_tokens, n_types, _ = totals[1]
        self.tokens, self.types = n_tokens, n_types
        grams = ngrams(words, sizes, order)
        begins = np.cumsum(sizes) - sizes
        unigrams = grams[0][0]
        extra = np.append(unigrams, BEGIN) if order > 1 else unigrams
        every, inverse = np.unique(extra, return_inverse=True)
        found = counts[1][inverse]
        first = int(found[-1]) if order > 1 else 0  # texts learned from: the count of BEGIN
        count = found[: len(words)]
        self.count_of = count
        base = np.log10((count + 1.0) / (n_tokens + n_types + 1.0))
        self.base = base
        self.weight, self.state, self.fail = [base], [np.ones(len(words), bool)], [0.0]
        probability = (count + 1.0) / (n_tokens + n_types + 1.0)
        for length in range(2, order + 1):
            keys, has = grams[length - 1]
            _, inverse = np.unique(keys[has], return_inverse=True)
            own = np.zeros(len(words), np.int64)
            own[has] = counts[length][inverse]
            context = np.zeros(len(words), np.int64)
            context[1:] = count[:-1]
            if length == 2 and len(words):
                context[begins] = first
            context[~has] = 0
            seen, _, once = totals[length]
            back = min(max(once / seen if seen else 1.0, 0.01), 0.99)
            known = own > 0
            share = np.divide(own, context, out=np.zeros(len(words)), where=context > 0)
            probability = np.where(context > 0, (1 - back) * share + back * probability, probability)
            self.weight.append(np.where(known, np.log10(probability), np.nan))
            self.state.append(count > 0)
            self.fail.append(float(np.log10(back)))
            count = own
        # A text begins in the state of BEGIN, if there was a text to learn from.
        self.start = 1 if order > 1 and first > 0 else 0

    def scores(self, sizes: np.ndarray) -> list[float]:
        out, at = [], 0
        top = self.order - 1
        fail = self.fail
        for n in sizes.tolist():
            weight = [w[at : at + n].tolist() for w in self.weight]
            state = [s[at : at + n].tolist() for s in self.state]
            total, m = 0.0, self.start
            for i in range(n):
                w = weight[m][i]
                while w != w:  # no arc: along the failure arc
                    total += fail[m]
                    m -= 1
                    w = weight[m][i]
                total += w
                m = m + 1 if m < top else top
                while m and not state[m][i]:
                    m -= 1
            out.append(total)
            at += n
        return out


def dealt(size: int, order: int) -> tuple[int, int]:
    """(buckets, shards) for ``size`` bytes of text."""
    return 1 + size // BUCKET_BYTES, max(SHARDS, order * size // SHARD_BYTES)


def scored(
    df: DataFrame, held_out: Column, order: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row;
    the model learns from rows where ``held_out`` is false or null."""
    n = shuffle_partitions(df.sparkSession)
    size = df.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0] or 0
    buckets, shards = dealt(size, order)
    text = text_or_empty(text_col)
    docs = df.select(
        F.pmod(F.xxhash64(id_col, text), F.lit(buckets)).cast("int").alias("bucket"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
        text.alias("text"),
    ).repartition(n, "bucket")

    def ask(table: pa.Table) -> pa.Table:
        words, sizes = tokens(table.column("text"))
        train = ~table.column("held").to_numpy()
        bucket = table.column("bucket")[0].as_py()
        return pa.Table.from_batches(list(requests(bucket, words, sizes, train, order, shards)), schema=_REQUEST)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        words, sizes = tokens(left.column("text"))
        found: dict[int, np.ndarray] = {}
        totals: dict[int, tuple[int, int, int]] = {}
        for length in range(1, order + 1):
            rows = sorted(
                (r for r in zip(*[c.to_pylist() for c in right.columns], strict=True) if r[2] == length), key=lambda r: r[1]
            )
            parts = []
            for r in rows:
                part = np.frombuffer(r[3], np.uint8).astype(np.int64)
                part[np.frombuffer(r[4], np.uint32)] = np.frombuffer(r[5], np.int64)
                parts.append(part)
            found[length] = np.concatenate(parts)
            totals[length] = rows[0][6:]
        model = Automaton(words, sizes, order, found, totals)
        begins = np.cumsum(sizes) - sizes
        return pa.table(
            {
                "id": left.column("id"),
                "held_out": left.column("held"),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(np.add.reduceat((model.count_of > 0).astype(np.int64), begins)),
                "train_tokens": pa.array(np.full(len(sizes), model.tokens)),
                "base_score": pa.array(np.add.reduceat(model.base, begins)),
                "score": pa.array(model.scores(sizes)),
            }
        )

    asked = docs.groupBy("bucket").applyInArrow(ask, REQUEST)
    asked = asked.repartitionById(min(n, shards), F.pmod("shard", F.lit(min(n, shards))).cast("int"))
    asked = asked.sortWithinPartitions("shard", "length")
    totals = asked.mapInArrow(shares, TOTAL).groupBy("length").agg(*[F.sum(c).alias(c) for c in ("tokens", "types", "once")])
    answered = asked.mapInArrow(answers, ANSWER).join(F.broadcast(totals), "length")  # a row per length
    answered = answered.select("bucket", "shard", "length", "low", "place", "high", "tokens", "types", "once")
    out = docs.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(
        score,
        "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return out.withColumnRenamed("id", id_col)
