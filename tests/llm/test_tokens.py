"""Byte-level BPE and token counts against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import bpe, queries, token_counts

from conftest import SF_DIR  # isort: skip

RANKS = P.path("byte_bpe_50k.tiktoken")


def strings(seed, n):
    rng = random.Random(seed)
    kinds = ["ab '\n", "a1 .'s\t é", " \n", "'slvre a1", "ab", "日本語漢字 a", "😀👍🏽‍", "a!b? "]
    return ["".join(rng.choices(rng.choice(kinds), k=rng.randint(0, 3000))) for _ in range(n)]


EDGES = ["", " ", "a" * 30_000, " " * 5000 + "x", "x" + "\n" * 4000, "a" + " " * 2000, "\x1c\x1d x\x85 y", "<|endoftext|> a"]


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.read_ranks(RANKS), P.PATTERN)


def by_match(enc, text):
    out = []
    for match in regex.findall(P.PATTERN, text):
        out += enc._encode_single_piece(match)
    return out


def test_pieces_change_nothing(enc):
    for t in [*EDGES, *strings(1, 60)]:
        want = by_match(enc, t)
        assert bpe.encode_text(enc, t) == want
        for most in (1, 7, 400):
            got = [i for p in bpe.pieces(t, most) for i in enc.encode_ordinary(p)] if len(t) < 4000 else want
            assert got == want


def test_encode_decode_rows(spark, enc):
    rows = [(1, "Straße 12\n\n  x"), (2, None), (2, ""), (None, "é" * 50), (1, "Straße 12\n\n  x")]
    df = spark.createDataFrame([(*r, "n_tokens") for r in rows], "doc_id long, text string, ids string")
    out = bpe.encoded(df, RANKS, P.PATTERN)
    back = out.withColumn("back", bpe.decode(spark, RANKS, P.PATTERN, "ids")).withColumn("list", bpe.unpack_ids(F.col("ids")))
    got = sorted((str(r.doc_id), bytes(r.back).decode(), r["list"], r.n_tokens) for r in back.collect())
    want = sorted((str(i), t or "", enc.encode_ordinary(t or ""), len(enc.encode_ordinary(t or ""))) for i, t in rows)
    assert got == want
    assert bpe.encoded(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_round_trip_takes_one_worker(spark, documents):
    """Each evaluation in a plan is a further Python worker for every running task."""
    from tidewater.llm import stages

    for df in (queries.op1(spark, SF_DIR), stages.byte_bpe(spark, documents, SF_DIR)):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_results_leave_in_parts(enc):
    """The results of a large batch, here of 10 MB, are never held as a whole."""
    texts = pa.array(["Quiet boats came in, 12 gulls. " * 107] * 3_000)
    rows = 0
    for out in bpe.coded(enc, iter([texts]), back=True):
        assert out.nbytes < 4 * bpe.PART
        assert out.field("decoded").cast(pa.string()).equals(texts.slice(rows, len(out)))
        rows += len(out)
    assert rows == len(texts)


def test_round_trip_rows(spark, enc):
    rows = [(1, "Straße 12\n\n  x"), (2, None), (2, ""), (None, "é" * 50), (3, "ab 1" * (bpe.PART // 3)), (4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    both = bpe.round_trip(spark, RANKS, P.PATTERN, "text").alias("c")
    got = [(r.doc_id, r.c.n_tokens, bytes(r.c.ids), bytes(r.c.decoded)) for r in df.select("doc_id", both).collect()]
    ids = [np.asarray(bpe.encode_text(enc, t or ""), "<u4") for _, t in rows]
    assert got == [(i, len(n), n.tobytes(), (t or "").encode()) for (i, t), n in zip(rows, ids, strict=True)]
    assert df.limit(0).select(both).count() == 0


def test_op1_equals_library(spark, enc, texts):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op1(spark, SF_DIR).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {
        i: (len(ids := enc.encode_ordinary(t or "")), digest(np.array(ids, "<u4").tobytes()), digest((t or "").encode()))
        for i, t in texts
    }


def test_counts_equal_library():
    count = token_counts.Counter(open(P.path("byte_bpe_50k.json"), "rb").read(), P.PATTERN)
    every = [*EDGES, "<|endoftext|><|endoftext|>b<|endoftext", *strings(2, 120)]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [len(e.ids) for e in library.encode_batch(every, add_special_tokens=False)]
    assert count.count(every) == want
    long_word = "".join(random.Random(3).choices("abcdefghijklmnop", k=20_000))
    assert count.count([long_word]) == [len(library.encode(long_word).ids)]


def test_op8_equals_library(spark, texts):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8(spark, SF_DIR).collect()}
    assert got == {i: (len((t or "").encode()), want[i], want[i] > 512) for i, t in texts}


def test_counts_of_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (1, "a a")], "doc_id long, text string")
    rows = token_counts.counted(df, P.path("byte_bpe_50k.json"), P.PATTERN, 1).collect()
    assert sorted(tuple(r)[1:] for r in rows) == [(0, 0, False), (0, 0, False), (3, 2, True)]
