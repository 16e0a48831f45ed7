"""Fill-in-the-middle, document fingerprints and vector codes against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import connect, diff
from conftest import SF_DIR
from tidewater.llm import fill_middle, fingerprint, queries, registry, vector_codes

ALPHABETS = ["ab ", "aé ", "日本 x", "😀a", "é", "<PSM>"]


def strings(seed, n, most=200):
    rng = random.Random(seed)
    return ["".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(0, most))) for _ in range(n)]


# --- fill in the middle -----------------------------------------------------


def test_units_of_words():
    for text in [*strings(1, 200, 40), "", "a" * 64, "日" * 64]:
        raw = text.encode()
        units = fill_middle.Units(np.frombuffer(raw, np.uint8))
        ends = [0]
        for c in text:
            ends.append(ends[-1] + len(c.encode()))
        assert units.after(np.arange(len(text) + 1)).tolist() == ends
        want = [sum(1 for e in ends[1:] if e <= at) for at in range(len(raw) + 1)]
        assert units.before(np.arange(len(raw) + 1)).tolist() == want


def test_cuts_of_slices(monkeypatch):
    texts = strings(2, 300)
    rng = np.random.default_rng(3)
    one, two = rng.integers(0, 1 << 32, (2, len(texts)))
    monkeypatch.setattr(fill_middle, "SLICE", 500)
    found = np.stack(fill_middle.cuts(pa.array(texts), one, two), axis=1).tolist()
    for t, a, b, row in zip(texts, one.tolist(), two.tolist(), found):
        low, high = sorted((a % (len(t) + 1), b % (len(t) + 1)))
        assert row == [len(t), low, high, len(t[:low].encode()), len(t[:high].encode())]


def plain_middle(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    one, two, three, four = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or three % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    if four % 100 < 20:
        return n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


def test_rearranged_rows(spark):
    rows = [*enumerate(strings(4, 300)), (None, "null id"), (7, None), (8, ""), (9, "a<S>b"), (9, "a<S>b"), (10, "<P"), (11, "M>")]
    rows.append((12, "é日😀 x" * 1_000_000))
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, n string, form string, output int")
    out = fill_middle.rearranged(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = sorted((str(r.doc_id), r.back, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    key = lambda r: (r[0], r[1], r[2], r[3])
    want = sorted(((str(i), t or "", *plain_middle(i, t)) for i, t in rows), key=key)
    assert sorted(got, key=key) == want
    assert {r[3] for r in want} == {"plain", "psm", "spm"}
    assert fill_middle.rearranged(df.limit(0)).count() == 0


# --- fingerprints -----------------------------------------------------------


def plain_digest(text):
    raw = b"\xff\xff" + text.encode() + b"\xff\xff"
    count = Counter()
    for i in range(len(raw) - 2):
        v = int.from_bytes(raw[i : i + 3], "little") * 0x9E3779B1 & 0xFFFFFFFF
        v ^= v >> 15
        count[(v * 0x85EBCA77 & 0xFFFFFFFF) >> 24] += 1
    ranked = sorted(count[b] for b in range(256))
    codes = [sum(count[b] > ranked[k] for k in (63, 127, 191)) for b in range(256)]
    packed = bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 256, 4))
    return packed + int(np.rint(8 * np.log2(1 + len(text.encode())))).to_bytes(2, "big")


def plain_likeness(a, b):
    quartiles = lambda x: [c >> s & 3 for c in x[:-2] for s in (6, 4, 2, 0)]
    qa, qb = quartiles(a), quartiles(b)
    unrelated = sum(abs(x - y) for x in qa for y in qb) / 256**2
    apart = sum(abs(x - y) for x, y in zip(qa, qb)) / 256 / max(unrelated, 1 / 256)
    length = abs(int.from_bytes(a[-2:], "big") - int.from_bytes(b[-2:], "big"))
    return 1 - min(1, apart + 0.25 * min(length, 32) / 32)


def plain_beside(rows):
    """{id: ...} for rows of different ids."""
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        made = t[: len(t) - n] + following[:n]
        own, changed, later = (plain_digest(x) for x in (t, made, following))
        out[i] = (len(t), hashlib.sha256(made.encode()).hexdigest(), own.hex(), changed.hex(), plain_likeness(own, changed), plain_likeness(own, later))
    return out


def equal(got, want):
    assert set(got) == set(want)
    for i, row in want.items():
        assert got[i][:4] == row[:4]
        assert got[i][4:] == pytest.approx(row[4:], abs=1e-9)


def test_beside_next_equals_brute_force(spark, texts):
    equal({r.doc_id: tuple(r)[1:] for r in queries.op13(spark, SF_DIR).collect()}, plain_beside(texts))


def test_fingerprints_of_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "SLICE", 300)
    rows = [*enumerate(strings(5, 60)), (-3, None), (100, ""), (101, "a"), (102, "a"), (1 << 40, "é" * 400_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, n_chars int")
    equal({r.doc_id: tuple(r)[1:] for r in fingerprint.beside_next(df).collect()}, plain_beside(rows))
    equal({r.doc_id: tuple(r)[1:] for r in fingerprint.beside_next(df.coalesce(1).limit(1)).collect()}, plain_beside(rows[:1]))
    assert fingerprint.beside_next(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "x y"), (1, "same"), (1, "same"), (1, "other")], "doc_id long, text string")
    out = fingerprint.beside_next(twice).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "1", "1", "None"]
    assert len({r.fingerprint for r in out}) == 3


def test_digests_and_likeness_as_columns(spark):
    df = spark.createDataFrame([("ab cd", "ab cd"), (None, ""), ("x", None), ("abc " * 90, "xyz " * 90)], "a string, b string")
    out = df.select("*", fingerprint.digest("a").alias("p"), fingerprint.digest("b").alias("q"))
    out = out.withColumn("near", fingerprint.likeness(F.col("p"), F.col("q")))
    for r in out.collect():
        p, q = plain_digest(r.a or ""), plain_digest(r.b or "")
        assert (r.p, r.q) == (p.hex(), q.hex())
        assert r.near == pytest.approx(plain_likeness(p, q), abs=1e-9)
    assert out.select(fingerprint.likeness(F.lit(None).cast("string"), F.col("q")).alias("x")).where("x is not null").count() == 0


def test_edited_texts_are_nearer_than_others(spark):
    rows = [r for r in queries.op13(spark, SF_DIR).collect() if r.near_next < 0.9 and r.n_chars >= 20]
    assert rows and all(r.near_edited > r.near_next for r in rows)


# --- vector codes -----------------------------------------------------------


def nearest(points, books):
    apart = ((points[:, :, None, :] - books[:, None, :, :]) ** 2).sum(axis=3)
    return apart.argmin(axis=2)  # the first one on a tie


@pytest.mark.parametrize("n,entries,width,spread", [(1, 1, 1, 3), (7, 5, 2, 2), (500, 64, 4, 40), (900, 64, 4, 3), (300, 17, 3, 1000), (2048, 64, 4, 300)])
def test_dual_trees_equal_brute_force(n, entries, width, spread):
    rng = np.random.default_rng(n)
    centres = rng.integers(-spread, spread, (3, 12, width)) * 8
    points = centres[np.arange(3)[:, None], rng.integers(0, 12, (3, n))] + rng.integers(-spread, spread + 1, (3, n, width))
    books = points[:, rng.integers(0, n, entries)]  # repeated entries are ties
    got = vector_codes.Assignment(points, books)
    codes = nearest(points, books)
    assert (got.in_order(n) == codes).all()
    for p in range(3):
        for e in range(entries):
            assert got.count[p, e] == (codes[p] == e).sum()
            assert (got.total[p, e] == points[p, codes[p] == e].sum(axis=0)).all()


def test_nodes_are_assigned_whole():
    rng = np.random.default_rng(5)
    books = rng.integers(-5000, 5000, (16, 64, 4))
    points = books[np.arange(16)[:, None], rng.integers(0, 64, (16, 2048))] + rng.integers(-20, 21, (16, 2048, 4))
    got = vector_codes.Assignment(points, books)
    assert got.whole > 0.75 * 16 * 2048  # the others are in leaves that hold parts of two groups
    assert (got.in_order(2048) == nearest(points, books)).all()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    fine = [(i, v, y) for i, v, y in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0], [np.floor(256 * x) for x in r[1]]))
    fine = [r for r in fine if len(r[1]) == len(fine[0][1])]
    points = np.array([[int(np.floor(256 * float(np.float32(x)))) for x in v] for _, v, _ in fine], np.int64)
    points = points.reshape(len(fine), parts, -1).transpose(1, 0, 2)
    books = points[:, :entries].copy()
    for _ in range(rounds):
        codes = nearest(points, books)
        for p in range(parts):
            for e in range(books.shape[1]):
                own = points[p, codes[p] == e]
                if len(own):
                    books[p, e] = [int(s) // len(own) for s in own.sum(axis=0)]
    codes = nearest(points, books)
    errors = ((points - books[np.arange(parts)[:, None], codes]) ** 2).sum(axis=(0, 2)).tolist()
    by_label = Counter()
    for (_, _, y), e in zip(fine, errors):
        by_label[y] += e
    whole = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(
        (str(i), "".join(f"{c:02x}" for c in codes[:, k]), errors[k], by_label[y], whole) for k, (i, _, y) in enumerate(fine)
    )


def test_codes_of_edge_rows(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(0, 2, 32).astype("f4").tolist(), i % 3) for i in range(150)]
    nan, inf = float("nan"), float("inf")
    vectors += [(-9, None, 1), (-8, [], 1), (-7, [1.0] * 31 + [None], 1), (-6, [nan] * 32, 1), (-5, [inf] * 32, 2), (-4, [-inf] + [0.0] * 31, 2)]
    vectors += [(200, [0.5] * 32, None), (201, [0.5] * 32, None), (3, [0.25] * 32, 1), (3, vectors[3][1], 1), (None, [-0.001] * 32, 1), (202, [1.0] * 16, 0)]
    df = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, embedding array<float>, label int, code int, error string")
    out = vector_codes.coded(df.repartition(5)).withColumn("code", F.lower(F.hex("code")))
    assert sorted((str(r.vec_id), *tuple(r)[1:]) for r in out.collect()) == plain_codes(vectors)
    few = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<float>, label int")
    out = vector_codes.coded(few).withColumn("code", F.lower(F.hex("code")))
    assert sorted((str(r.vec_id), *tuple(r)[1:]) for r in out.collect()) == plain_codes(vectors[:3])
    for none in (few.limit(0), few.withColumn("embedding", F.lit(None).cast("array<float>"))):
        assert vector_codes.coded(none).count() == 0


def test_lengths_that_parts_do_not_divide(spark):
    df = spark.createDataFrame([(1, [1.0] * 30, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError, match="16 equal parts"):
        vector_codes.coded(df)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_fill_middle"])
def test_queries_equal_sql(spark, name):
    assert diff(registry.queries()[name](spark, SF_DIR), connect(SF_DIR), registry.oracle_sql()[name]) is None
