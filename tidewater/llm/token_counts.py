"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie one after another in flat numpy arrays.
In each round every sequence applies its own lowest-rank pair at all places
where that pair occurs (left to right without overlap), all sequences at the
same time; the symbols that survive are the tokens.  A merge yields a symbol
that only rules of higher rank contain, so this gives what one merge at a time
gives.  Counts of pre-tokens seen before come from a table of fixed size.

Very long pre-tokens take their rounds from buckets of places by rank, so that
a round costs the places it touches and not the whole sequence.

Defined results: a null text has no bytes and no tokens; repeated rows give
repeated results; a special string inside a text counts as one token, as the
vocabulary file declares it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import text_or_empty

NEVER = np.int64(2**62)
LONG = 512  # bytes from which on a pre-token is merged by buckets
KNOWN = 400_000  # pre-tokens whose counts a worker keeps
TOGETHER = 4_000_000  # bytes of new pre-tokens merged at once
CHARS = 4_000_000  # characters pre-split before their new pre-tokens are merged

# The byte-level alphabet. Printable bytes stand for themselves,
# the others follow from code point 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[int, str]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Merge rules as sorted arrays: pair of symbol ids to rank and result."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model = spec["model"]
        kind = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or spec.get("normalizer") is not None:
            raise ValueError("a byte-level BPE vocabulary without normaliser is expected")
        if kind.get("add_prefix_space") or not kind.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError("unsupported pre-tokeniser options")
        ids = model["vocab"]
        alphabet = byte_alphabet()
        self.first = np.array([ids[alphabet[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        keys, where = np.unique(keys, return_index=True)  # the first rule of a pair counts
        # A last key that no pair has, so that a search always lands inside.
        self.keys = np.append(keys, NEVER)
        self.ranks = np.append(where.astype(np.int64), NEVER)
        self.made = np.append(made[where], -1)
        specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = (
            regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        )

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks, results) of pairs; ``NEVER`` where there is no rule."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), self.made[at]


def alternate(chosen: np.ndarray) -> np.ndarray:
    """Of neighbouring places (each one after the last), every other one from the left."""
    fresh = np.ones(len(chosen), bool)
    fresh[1:] = chosen[1:] != chosen[:-1] + 1
    begins = np.flatnonzero(fresh)
    place = np.arange(len(chosen)) - np.repeat(begins, np.diff(np.append(begins, len(chosen))))
    return chosen[place % 2 == 0]


def merged_counts(rules: Merges, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Surviving symbols of each sequence of ``lengths`` bytes in ``raw``."""
    counts = lengths.astype(np.int64).copy()
    own = np.flatnonzero(lengths > 0)  # sequence numbers still in play
    symbol = rules.first[raw]
    size = lengths[own].astype(np.int64)
    while len(own):
        begin = np.cumsum(size) - size
        end = begin + size - 1
        # Rank of the pair that starts at each place; the last place of a sequence starts none.
        rank = np.full(len(symbol), NEVER)
        made = np.zeros(len(symbol), np.int64)
        rank[:-1], made[:-1] = rules.find(symbol[:-1], symbol[1:])
        rank[end] = NEVER
        lowest = np.minimum.reduceat(rank, begin)
        live = lowest < NEVER
        of = np.repeat(np.arange(len(own)), size)
        chosen = np.flatnonzero((rank == lowest[of]) & live[of])
        chosen = alternate(chosen)
        symbol[chosen] = made[chosen]
        keep = np.repeat(live, size)  # finished sequences leave
        keep[chosen + 1] = False
        size = size - np.bincount(of[chosen], minlength=len(own))
        counts[own] = size
        symbol, own, size = symbol[keep], own[live], size[live]
    return counts


def merged_count_long(rules: Merges, raw: np.ndarray) -> int:
    """Surviving symbols of one long sequence; places wait in a bucket per rank."""
    n = len(raw)
    symbol = rules.first[raw]
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    alive = np.ones(n, bool)
    buckets: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def put(places: np.ndarray) -> None:
        ranks, _ = rules.find(symbol[places], symbol[after[places]])
        places, ranks = places[ranks < NEVER], ranks[ranks < NEVER]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for part in np.split(np.arange(len(ranks)), cuts) if len(ranks) else []:
            rank = int(ranks[part[0]])
            if rank not in buckets:
                buckets[rank] = []
                heapq.heappush(waiting, rank)
            buckets[rank].append(places[part])

    put(np.arange(n - 1))
    left = n
    while waiting:
        rank = heapq.heappop(waiting)
        places = np.unique(np.concatenate(buckets.pop(rank)))
        places = places[alive[places]]
        places = places[after[places] < n]
        ranks, made = rules.find(symbol[places], symbol[after[places]])
        places, made = places[ranks == rank], made[ranks == rank]
        if not len(places):
            continue
        # Of chained places (the next place is the second half of this pair) every other one.
        fresh = np.ones(len(places), bool)
        fresh[1:] = after[places[:-1]] != places[1:]
        begins = np.flatnonzero(fresh)
        turn = np.arange(len(places)) - np.repeat(begins, np.diff(np.append(begins, len(places))))
        places, made = places[turn % 2 == 0], made[turn % 2 == 0]
        gone = after[places]
        alive[gone] = False
        symbol[places] = made
        after[places] = after[gone]
        inner = places[after[places] < n]
        before[after[inner]] = inner
        left -= len(places)
        touched = np.unique(np.concatenate([places, before[places]]))
        touched = touched[touched >= 0]
        put(touched[after[touched] < n])
    return left


class Counter:
    """Token counts of texts; keeps the counts of known pre-tokens."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.rules = Merges(vocabulary)
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def learn(self, words: list[str]) -> None:
        if len(self.known) > KNOWN:
            self.known.clear()
        raw = [w.encode() for w in words]
        short = [i for i, b in enumerate(raw) if len(b) < LONG]
        for i in range(0, len(short), 200_000):
            part = short[i : i + 200_000]
            flat = np.frombuffer(b"".join(raw[k] for k in part), np.uint8)
            sizes = np.array([len(raw[k]) for k in part], np.int64)
            for k, c in zip(part, merged_counts(self.rules, flat, sizes).tolist(), strict=True):
                self.known[words[k]] = c
        for k, b in enumerate(raw):
            if len(b) >= LONG:
                self.known[words[k]] = merged_count_long(self.rules, np.frombuffer(b, np.uint8))

    def parts(self, text: str) -> tuple[list[str], int]:
        """(texts between special strings, number of special strings)."""
        special = self.rules.special
        if special is None or not special.search(text):
            return [text], 0
        found = len(special.findall(text))
        return special.split(text), found

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out: list[int] = []
        group: list[tuple[list[list[str]], int]] = []
        chars = 0
        for text in texts:
            parts, special = self.parts(text)
            group.append(([self.split.findall(p) for p in parts], special))
            chars += len(text)
            if chars >= CHARS:
                out += self._counts(group)
                group, chars = [], 0
        return out + self._counts(group)

    def _counts(self, group: list[tuple[list[list[str]], int]]) -> list[int]:
        known = self.known
        fresh = {w for lists, _ in group for words in lists for w in words if w not in known}
        if fresh:
            if len(known) + len(fresh) > KNOWN:
                known.clear()
                fresh = {w for lists, _ in group for words in lists for w in words}
            self.learn(list(fresh))
        get = self.known.__getitem__
        return [special + sum(sum(map(get, words)) for words in lists) for lists, special in group]


_COUNTERS: dict[tuple[int, str], Counter] = {}


def counter(vocabulary: bytes, pattern: str) -> Counter:
    key = (hash(vocabulary), pattern)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(vocabulary, pattern)
    return _COUNTERS[key]


def token_count(spark: SparkSession, vocabulary_path: str, pattern: str, text: str | Column) -> Column:
    """Tokens (long) of a text column by a byte-level BPE vocabulary file."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # its size is the vocabulary's

    @F.arrow_udf("long")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(vocabulary.value, pattern)
        for batch in batches:
            yield pa.array(own.count(batch.to_pylist()), pa.int64())

    return counts(text_or_empty(text))


def counted(
    df: DataFrame,
    vocabulary_path: str,
    pattern: str,
    limit: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row."""
    out = df.select(
        F.col(id_col),
        F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"),
        token_count(df.sparkSession, vocabulary_path, pattern, text_col).alias("n_tokens"),
    )
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
