"""Near-duplicates, repeated bytes and decontamination against brute force and SQL."""

import random

import hashlib
import numpy as np
import pyarrow as pa
import pytest
from compare import connect, diff
from pyspark.sql import functions as F

import brute
from conftest import SF_DIR
from tidewater.llm import decontaminate, near_dedup, queries, suffix_dedup


def near(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component long")
    return [tuple(r) for r in near_dedup.grouped(df, **options).collect()]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_groups_of_documents(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op2(spark, SF_DIR).collect()}
    assert got == brute.near_groups(texts)


@pytest.mark.parametrize("small", [32, 4])
def test_near_copies(spark, monkeypatch, small):
    """A dense group, a loose cloud whose nodes stay large, chains and short texts."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "COPIES", 16 if small > 4 else 4)
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(i, edited(rng, base, 1)) for i in range(60)]
    rows += [(100 + i, edited(rng, base, rng.randrange(2, 9))) for i in range(60)]
    chain = [f"c{i}" for i in range(160)]
    for i in range(20):
        chain[i * 5] = f"x{i}"
        rows.append((300 + i, " ".join(chain)))
    rows += [(400, "one two"), (401, "ONE  two"), (402, "one"), (403, None), (404, ""), (405, " \t"), (406, "one two three")]
    want = brute.near_groups(rows)
    got = {r[0]: r[1:] for r in near(spark, rows)}
    assert got == want


def test_near_copies_of_short_texts(spark):
    """Texts of 10 words and their copies with one word more: Jaccard 6 / 7."""
    rng = random.Random(8)
    rows = []
    for i in range(0, 1000, 2):
        words = [f"s{rng.randrange(10**6)}" for _ in range(11)]
        rows += [(i, " ".join(words[:10])), (i + 1, " ".join(words))]
    assert {r[0]: r[1:] for r in near(spark, rows)} == brute.near_groups(rows)


def test_empty_bins_are_filled_evenly():
    rng = near_dedup.np.random.default_rng(9)
    sets = [near_dedup.np.sort(rng.integers(0, 1 << 63, 7, near_dedup.U64) * near_dedup.U64(2)) for _ in range(400)]
    whole = near_dedup.signature_rows(sets)
    less = near_dedup.signature_rows([near_dedup.np.delete(s, k % 7) for k, s in enumerate(sets)])
    agree = (whole == less).mean(axis=1)
    assert abs(agree.mean() - 6 / 7) < 0.01 and agree.std() < 0.04


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("union", [7, 10, 14, 20, 40, 60, 66, 80, 160, 400, 1000, 3000])
def test_filter_keeps_pairs_at_the_similarity(percent, union):
    """Sets whose similarity is the threshold or little more pass; of those far below few do."""
    np = near_dedup.np
    rng = np.random.default_rng(union)

    def pairs(common, n):
        sets = [np.unique(rng.integers(0, 1 << 63, union, near_dedup.U64) * near_dedup.U64(2)) for _ in range(n)]
        cut = [(rng.permutation(s), (union - common) // 2) for s in sets]
        a = [np.sort(s[: common + k]) for s, k in cut]
        b = [np.sort(np.concatenate([s[:common], s[common + k :]])) for s, k in cut]
        sizes = [np.array([len(x) for x in y]) for y in (a, b)]
        return near_dedup.similar(*sizes, near_dedup.full_rows(a), near_dedup.full_rows(b), percent)

    n = 3000 if union <= 400 else 400
    assert pairs(-(-union * percent // 100), n).mean() >= 1 - 1 / n
    if union > near_dedup.TINY:
        assert pairs(union // 2, 200).mean() < 0.05


def test_recall_at_the_greatest_depth():
    deepest = near_dedup.FIRST_LEVELS + near_dedup.STEP * near_dedup.ROUNDS
    assert near_dedup.missed(near_dedup.PERCENT, near_dedup.TREES, deepest) < 1e-4


def test_near_nodes_at_the_greatest_depth(spark, monkeypatch):
    """Nodes that are still mixed and large after the last step are compared whole."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "COPIES", 1)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    rng = random.Random(10)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(i, edited(rng, base, rng.randrange(1, 7))) for i in range(80)]
    assert {r[0]: r[1:] for r in near(spark, rows)} == brute.near_groups(rows)


@pytest.mark.parametrize("percent", [70, 80, 85])
def test_near_groups_in_chunks_and_blocks(spark, monkeypatch, percent):
    """Many chunks and blocks per node; strays beside a large group; the first tree emits."""
    for name, value in {"SMALL": 4, "BLOCK": 3, "CHUNK": 6, "COPIES": 2}.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(percent)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [(i, edited(rng, base, rng.choice([0, 1, 1, 2, 3, 5, 8]))) for i in range(140)]
    rows += [(200 + i, edited(rng, base[:75] + [f"t{rng.randrange(50)}" for _ in range(75)], 4)) for i in range(60)]
    got = {r[0]: r[1:] for r in near(spark, rows, percent=percent, trees=40)}
    assert got == brute.near_groups(rows, percent=percent)


@pytest.mark.parametrize("n_major,n_other", [(1, 1), (7, 1), (20, 3), (9, 11), (2, 16)])
def test_blocks_bring_all_pairs_together(spark, monkeypatch, n_major, n_other):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    n = n_major + n_other
    data = [(0, 77, i, 9, n, -5 if i < n_major else i, -5, n_major) for i in range(n)]
    df = spark.createDataFrame(data, "tree int, node long, id long, n long, size long, label long, major long, n_major long")
    units = {}
    for r in near_dedup.blocks(df).collect():
        units.setdefault(r.node, []).append((r.id, r.block))
    met = [
        tuple(sorted((x, y)))
        for rows in units.values()
        for k, (x, a) in enumerate(rows)
        for y, b in rows[k + 1 :]
        if x != y and (a < 0 or a != b) and not (x < n_major and y < n_major)
    ]
    assert set(met) == {(x, y) for x in range(n) for y in range(x + 1, n) if y >= n_major}
    assert len(met) == len(set(met))


def test_first_shared_tree():
    """Against the nodes of either document; large nodes count through the masks."""
    np = near_dedup.np
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (80, near_dedup.COORDINATES)).astype(np.uint8)
    b = np.where(rng.random(a.shape) < rng.choice([0.3, 0.6, 0.9], (80, 1)), a, rng.integers(0, 256, a.shape).astype(np.uint8))
    mask_a, mask_b = rng.integers(0, 1 << 24, (2, 80)) | ((rng.random(80) < 0.5) * ((1 << 24) - 1)).astype(np.int64)

    def nodes(sig, tree, levels):
        at, rows = near_dedup.tree_root(tree).repeat(len(sig)), np.arange(len(sig))
        for _ in range(levels):
            at, rows = near_dedup.children(at, rows, sig, 85)
        return [set(at[rows == k].tolist()) for k in range(len(sig))]

    shared = {n: [[bool(x & y) for x, y in zip(nodes(a, t, n), nodes(b, t, n))] for t in range(24)] for n in (3, 7)}
    got = near_dedup.first_shared(a, b, mask_a, mask_b, 24, 3, 7, 85)
    for k in range(80):
        large = (mask_a[k] & mask_b[k]).item()
        own = [t for t in range(24) if shared[7][t][k] or shared[3][t][k] and not large >> t & 1]
        assert got[k] == (own[0] if own else -1)


def test_near_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = near(spark, [(5, text), (5, text), (None, text), (9, text), (None, None)])
    assert sorted(rows, key=str) == sorted(
        [(5, 26, 5, True), (5, 26, 5, True), (None, 26, None, True), (9, 26, 5, False), (None, 0, None, True)], key=str
    )
    assert near(spark, [(1, "a")])[0] == (1, 1, 1, True)
    other = " ".join(f"v{i}" for i in range(30))
    shared = [(1, text), (2, text + " x"), (2, other), (4, other), (4, other + " y"), (0, "z")]
    want = [(0, 1, 0, True), (1, 26, 1, True), (2, 26, 2, True), (2, 27, 1, False), (4, 26, 2, False), (4, 27, 2, False)]
    assert sorted(near(spark, shared)) == want
    assert near_dedup.grouped(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def kept_rows(df, **options):
    rows = suffix_dedup.deduplicated(df, **options).collect()
    return {
        r.doc_id: (
            len((r.text or "").encode()),
            sum(s.end - s.start for s in r.spans),
            len(r.spans),
            hashlib.sha256(r.kept).hexdigest(),
        )
        for r in rows
    }


def test_repeated_bytes_of_documents(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10(spark, SF_DIR).collect()}
    assert got == brute.repeated_bytes(texts)


@pytest.mark.parametrize("chunk", [1 << 20, 1500])
def test_repeated_bytes_of_mixtures(spark, monkeypatch, chunk):
    """Passages at changing places, runs of one letter, and texts longer than a chunk."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = random.Random(5)
    base = ["".join(rng.choices("ab é", k=rng.randint(50, 700))) for _ in range(12)]
    rows = []
    for i in range(80):
        t = "".join(rng.choice(base)[rng.randint(0, 100) :][: rng.randint(1, 500)] for _ in range(rng.randint(0, 5)))
        rows.append((i, None if i % 31 == 0 else "a" * rng.randint(90, 900) if i % 17 == 0 else t))
    big = "".join(rng.choices("abcdefgh ", k=9_000))
    rows += [(500, big), (501, big[1000:8000] + "x" + big[:3000])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, []) for r in rows], "doc_id long, text string, gram array<int>")
    assert kept_rows(df) == brute.repeated_bytes(rows)


def test_repeated_bytes_edge_rows(spark):
    text = "é" * 80
    df = spark.createDataFrame([(1, text), (1, text), (2, "x" + text), (None, text), (None, None)], "doc_id long, text string")
    rows = [(r.doc_id, r.text, sum(s.end - s.start for s in r.spans)) for r in suffix_dedup.deduplicated(df).collect()]
    lost = {(i, t): n for i, t, n in rows}
    # Within one text all but the first 100-byte string repeat at a shift of two bytes.
    assert lost[(1, text)] == 158 and lost[(2, "x" + text)] == 160 and lost[(None, text)] == 0
    whole = suffix_dedup.deduplicated(spark.createDataFrame([(1, "a" + text), (2, text[:60] + "b")], df.schema), whole_characters=True)
    assert all(bytes(r.kept).decode() is not None for r in whole.collect())
    assert suffix_dedup.deduplicated(df.limit(0)).count() == 0


def test_family_levels_merge_by_size():
    family = suffix_dedup.IndexFamily()
    for k in range(7):
        e = suffix_dedup.np.array([k], suffix_dedup.np.uint64)
        i = suffix_dedup.np.array([k])
        family.insert((e, e, i, i))
    assert [len(x[0]) if x else 0 for x in family.levels] == [1, 2, 4]


def test_decontamination_equals_sql(spark):
    assert diff(queries.op7(spark, SF_DIR), connect(SF_DIR), queries.OP7_SQL) is None


def test_decontamination_edge_rows(spark):
    cycle = " ".join(f"w{i % 5}" for i in range(60))
    docs = [(1, "x a b a b a b c"), (2, None), (3, "Ça ça ça"), (None, "a b"), (4, cycle), (5, ""), (1, "x a b a b a b c")]
    items = [(1, "a b"), (2, "A"), (3, None), (4, ""), (1, "a b"), (5, " ".join(f"w{i % 5}" for i in range(20))), (6, "çA")]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.matched(d, b).collect()), key=str)
    want = [(1, 8, 6, ["1", "2"])] * 2 + [(2, 0, 0, []), (3, 3, 2, ["6"]), (4, 60, 60, ["5"]), (5, 0, 0, []), (None, 2, 2, ["1", "2"])]
    assert got == sorted(want, key=str)
    assert {r.n_hit for r in decontaminate.matched(d, b.limit(0)).collect()} == {0}
    assert decontaminate.matched(d.limit(0), b).count() == 0


def test_every_long_shared_span_is_found(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"v{rng.randrange(40)}" for _ in range(rng.randint(13, 40)))) for i in range(20)]
    docs = []
    for i in range(40):
        w = items[rng.randrange(20)][1].split()
        at, n = rng.randrange(len(w)), rng.randint(10, 20)
        own = [f"u{rng.randrange(40)}" for _ in range(30)]
        cut = rng.randrange(30)
        docs.append((i, " ".join(own[:cut] + w[at : at + n] + own[cut:])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.matched(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    grams = {tuple(t.split()[k : k + 13]) for _, t in items for k in range(len(t.split()) - 12)}
    for i, t in docs:
        w = t.split()
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for p in range(k, k + 13)}
        assert got[i] == len(hit)


def test_short_items_of_every_length_in_one_scan(spark, tmp_path):
    """Items of 1 to 15 words against documents that hold, break and repeat them."""
    rng = random.Random(7)
    items = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(1 + i % 15))) for i in range(1, 46)]
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [" x ".join(t for _, t in items), items[13][1] + " " + items[13][1], items[1][1], "", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    d, b = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.matched(d, b)
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in out.collect()}
    want = {}
    for i, text in enumerate(texts):
        words, hit, named = (text or "").split(), set(), set()
        for item, t in items:
            of = t.split()
            windows = [of[k : k + 13] for k in range(max(1, len(of) - 12))]
            for w in windows:
                for at in range(len(words) - len(w) + 1):
                    if words[at : at + len(w)] == w:
                        hit |= set(range(at, at + len(w)))
                        named.add(str(item))
        want[i] = (len(words), len(hit), sorted(named))
    assert got == want and sum(n for _, n, _ in want.values()) > 500


def test_places_without_a_bit_stay_in_the_row(spark):
    """Of 20,000 words only those whose gram sets a bit of the short items' table become rows; no hit is lost."""
    text = " ".join(f"w{i}" for i in range(20_000))
    d = decontaminate.hashed(spark.createDataFrame([(1, text)], "id long, text string"), ["id"], "text")
    prints = spark.range(0, 20_000, 200).select(F.xxhash64(F.concat(F.lit("w"), "id")).alias("fingerprint"))
    left = decontaminate.winnowed(d, ["id"], 13, 8, (1, 2), decontaminate.bit_table(prints)).where("short")
    starts = {r.start for r in left.collect()}
    assert set(range(0, 20_000, 200)) <= starts and len(starts) < 200
    h = F.col("h")
    edge = spark.createDataFrame([(x,) for x in (0, -1, 63, -(2**63), 2**63 - 1)], "h long")
    table = decontaminate.bit_table(edge.withColumnRenamed("h", "fingerprint"))
    assert edge.where(decontaminate.has_bit(table, h)).count() == 5
    assert spark.range(64, 1000).where(decontaminate.has_bit(table, F.col("id"))).count() == 0


def test_documents_are_hashed_once_whatever_the_lengths(spark, monkeypatch, tmp_path):
    read = []
    plain = decontaminate.winnowed
    monkeypatch.setattr(decontaminate, "winnowed", lambda df, keep, *a: read.append(keep) or plain(df, keep, *a))
    d = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join("abcdefghijkl"[:i])) for i in range(1, 13)], "item_id long, text string")
    assert decontaminate.matched(d, b).first().n_hit == 5
    assert read.count(["id"]) == 1


def test_long_texts_of_5_mb(spark):
    """Near-duplicates and benchmark hits in texts of 5 MB, in closed form."""
    long = " ".join(f"w{i}" for i in range(700_000))
    item = " ".join(f"w{i}" for i in range(350_000, 350_020))
    rows = [(1, long), (2, long + " end"), (3, "w5 w6 w7"), (4, " ".join(f"v{i}" for i in range(700_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, "w7")], "item_id long, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.matched(df, b).collect()}
    assert hits == {1: (700_000, 21, ["1", "2"]), 2: (700_001, 21, ["1", "2"]), 3: (3, 1, ["2"]), 4: (700_000, 0, [])}
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.grouped(df).collect()}
    assert groups == {1: (699_996, 1), 2: (699_997, 1), 3: (1, 3), 4: (699_996, 4)}


def test_full_sets_leave_in_parts(monkeypatch):
    """A worker holds the sets of a few texts beside its batch, whatever the batch has."""
    monkeypatch.setattr(near_dedup, "PART", 500)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in [*rng.choices(range(200), k=300), 3000]]
    sets = list(near_dedup.shingles(pa.array(texts), 5))
    d1 = [int(near_dedup.first_digest(s).view(np.int64)) for s in sets]
    d1[7] += 1  # a row that shares the id of another text
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(d1)], names=["id", "text", "d1"])
    out = list(near_dedup.full_sets(iter([batch, batch.slice(0, 0)]), 5))
    sizes = [[len(v.as_py()) // 8 for v in b.column(1)] for b in out]
    assert all(sum(s) <= 500 or len(s) == 1 for s in sizes) and sum(map(len, sizes)) == len(texts) - 1
    got = {i: s for b in out for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert got == {i: s.astype("<u8").tobytes() for i, s in enumerate(sets) if i != 7}


def test_spans_are_evaluated_once(spark, documents, monkeypatch):
    """One worker a task for the spans, and no file per shard for the places."""
    plans, files, write = {}, {}, suffix_dedup.materialised

    def written(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        out = write(df, label)
        files[label] = len(out.inputFiles())
        return out

    monkeypatch.setattr(suffix_dedup, "materialised", written)
    shards = suffix_dedup.shuffle_partitions(spark) * suffix_dedup.SHARDS
    assert suffix_dedup.repeated_spans(documents).count() > 0
    assert plans["suffix-spans"].count("ArrowEvalPython") == 1
    assert files["suffix-found"] < shards
