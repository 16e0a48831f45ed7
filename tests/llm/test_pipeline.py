"""The pipeline's stages, each against what it is given."""

import hashlib

import corpus_pipeline
import pytest

import brute
from conftest import SF_DIR
from tidewater.llm import bpe, decontaminate, quality, queries, registry

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF_DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(runs):
    for df in runs[1:-1]:
        assert df.columns == COLUMNS


def test_quality_stage(spark, runs):
    rows, _ = quality.decided(runs[0], spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    assert ids(runs[1]) == ids(rows.where("kept"))


def test_near_stage(runs):
    groups = brute.near_groups([(r.doc_id, r.text) for r in runs[1].collect()], percent=80)
    assert ids(runs[2]) == sorted(i for i, g in groups.items() if g[2])


def test_passage_stage(runs):
    before = {r.doc_id: r for r in runs[2].collect()}
    want = brute.repeated_bytes([(i, r.text) for i, r in before.items()])
    after = {r.doc_id: r for r in runs[3].collect()}
    assert set(after) == set(before)
    for i, r in after.items():
        kept = r.text.encode()
        lost = want[i][1]
        # Characters cut by a span stay: at most three bytes at either end of a run.
        assert 0 <= len(kept) - (want[i][0] - lost) <= 6 * want[i][2]
        if lost == 0 or all(ord(c) < 128 for c in before[i].text):
            assert hashlib.sha256(kept).hexdigest() == want[i][3]
        assert r.n_chars == len(r.text)


def test_benchmark_stage(spark, runs):
    rows = decontaminate.matched(runs[3], spark.read.parquet(f"{SF_DIR}/benchmark.parquet"))
    assert ids(runs[4]) == ids(rows.where(~decontaminate.contaminated()))


def test_bpe_stage(runs):
    enc = bpe.encoder(bpe.read_ranks(queries.public_tokenizers.path(queries.RANKS)), queries.public_tokenizers.PATTERN)
    want = {r.doc_id: r.text or "" for r in runs[4].collect()}
    for r in runs[5].collect():
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in enc.encode_ordinary(want[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_stages_take_nulls_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (None, "a b", "en", None, 3), (2, "word " * 40, None, "s", 200), (2, "word " * 40, None, "s", 200)]
    docs = spark.createDataFrame([(*r, "") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() <= 4
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def decided(spark, name, rows):
    """Ids and tags (in ``lang``) of the rows that a stage leaves."""
    docs = spark.createDataFrame([(i, t, tag, "s", 1) for i, t, tag in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF_DIR).collect()
    return sorted((str(r.doc_id), r.lang) for r in out)


GOOD = "The harbour was quiet when the boats came in, and every crew unloaded crates of silver fish beside old stone steps under slowly turning gulls."
BAD = "buy now " * 60


def test_quality_verdicts_by_row(spark):
    """Null, shared and repeated ids: each row by its own text."""
    rows = [(None, BAD, "a"), (None, GOOD, "b"), (5, BAD, "c"), (5, GOOD, "d"), (5, GOOD, "e"), (6, None, "f")]
    assert decided(spark, "quality", rows) == [("5", "d"), ("5", "e"), ("None", "b")]


def test_near_verdicts_by_row(spark):
    other = " ".join(f"w{i}" for i in range(40))
    rows = [(1, GOOD, "a"), (2, GOOD + " Again.", "b"), (2, other, "c"), (2, other, "d"), (None, GOOD, "e"), (3, None, "f"), (4, other, "g")]
    assert decided(spark, "near", rows) == [("1", "a"), ("2", "c"), ("2", "d"), ("3", "f"), ("None", "e")]


def test_near_stage_takes_four_fifths(spark):
    """50 shingles, of which edits leave 46 and 42 in common: 0.85 and 0.72; 44: 0.79; 45: 0.82."""
    words = [f"w{i}" for i in range(54)]
    cut = lambda k: " ".join([*(f"x{i}" for i in range(k)), *words[k:]])
    rows = [(1, " ".join(words), "a"), (2, cut(5), "b"), (3, cut(6), "c")]
    assert decided(spark, "near", rows[:2]) == [("1", "a")]
    assert decided(spark, "near", [rows[0], rows[2]]) == [("1", "a"), ("3", "c")]


def test_benchmark_verdicts_by_row(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect() if len((r.text or "").split()) >= 13)
    rows = [(None, item, "a"), (None, GOOD, "b"), (5, item, "c"), (5, GOOD, "d"), (6, GOOD, "e"), (7, None, "f")]
    assert decided(spark, "benchmark", rows) == [("5", "d"), ("6", "e"), ("7", "f"), ("None", "b")]


def test_passages_by_row(spark):
    """Equal ids and null ids keep their rows; what repeats is cut from the later one."""
    rows = [(1, GOOD, "a"), (1, GOOD, "b"), (None, GOOD, "c"), (2, None, "d")]
    assert decided(spark, "passages", rows) == [("1", "a"), ("1", "b"), ("2", "d"), ("None", "c")]


def test_registry():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names and set(registry.oracle_sql()) <= set(names)
