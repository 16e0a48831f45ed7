"""Language model, quality rules, chat format, archives and pages."""

import gzip
import html
import io
import re
import time
import tracemalloc

import numpy as np
import pytest
from compare import connect, diff
from pyspark.sql import functions as F

import brute
from conftest import SF_DIR
from tidewater.llm import chat, html_text, lm, quality, queries, warc
from tidewater.llm.common import shared_dir

PYTHON = re.compile("Python|Pandas|Arrow")


def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def close(got, want):
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k][:4] == w[:4]
        assert got[k][4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


def test_lm_equals_recursion(spark, texts, documents):
    close({r.doc_id: tuple(r)[1:] for r in queries.op5(spark, SF_DIR).collect()}, brute.lm_scores(texts, 2))
    few = documents.where("doc_id < 60")
    rows = [(i, t) for i, t in texts if i < 60]
    close({r.doc_id: tuple(r)[1:] for r in lm.scored(few, held(), order=3).collect()}, brute.lm_scores(rows, 3))


def test_lm_beats_the_base_on_held_out_texts(spark):
    out = queries.op5(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_lm_edge_rows(spark):
    rows = [(1, "A b"), (1, "a b"), (2, None), (None, ""), (3, "zz " * 3000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, bucket int")
    out = lm.scored(df, F.lit(False)).collect()
    assert len(out) == 5 and {r.train_tokens for r in out} == {3 + 3 + 1 + 1 + 3001}
    assert {r.score for r in lm.scored(df, F.lit(True)).collect()} == {0.0}
    assert lm.scored(df.limit(0), F.lit(False)).count() == 0


def test_lm_messages_follow_the_text(spark, documents, monkeypatch):
    """Buckets and shards depend on bytes, never on shuffle partitions; a bucket sends a row per distinct n-gram at most."""
    assert lm.dealt(0, 2) == (1, lm.SHARDS)
    assert lm.dealt(40 * lm.BUCKET_BYTES, 2)[0] == 41
    words = np.array([5, 5, 9 << 60, lm.END], lm.U64)
    for shards in (64, 1 << 20):
        sent = list(lm.requests(0, words, np.array([4]), np.array([True]), 3, shards))
        assert [b.num_rows for b in sent] == [min(b.num_rows, 4) for b in sent]
        assert sum(len(r) for b in sent for r in b.column("keys").to_pylist()) == 8 * (4 + 4 + 3)
    empty = list(lm.requests(7, words[3:], np.array([1]), np.array([True]), 3, 64))[2]  # no n-gram of three words
    assert empty.num_rows == 1 and empty.column("keys").to_pylist() == [b""]
    monkeypatch.setattr(lm, "BUCKET_BYTES", 20000)
    few = documents.where("doc_id < 60")
    want, kept = None, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r.doc_id: tuple(r)[1:] for r in lm.scored(few, held(), order=3).collect()}
            close(got, want or got)
            want = got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_lm_distributions_sum_to_one(spark):
    """All words after a context, with one class for the unseen ones: text scores differ by the next word only."""
    train = [(0, "a b a c"), (1, "a b b"), (3, "c a")]
    ask = [(100 + k, f"a {w}") for k, w in enumerate(["a", "b", "c", "unseen"])]
    df = spark.createDataFrame([*train, *ask, (200, "a")], "doc_id long, text string")
    rows = {r.doc_id: r.score for r in lm.scored(df, F.col("doc_id") >= 100).collect()}
    counts = {"a": 4, "b": 3, "c": 2, "</s>": 3}
    n, v = 12, 4
    first = lambda w: (counts.get(w, 0) + 1) / (n + v + 1)
    after_a = {"b": 2, "c": 1, "</s>": 1}
    pairs = {("<s>", "a"): 2, ("<s>", "c"): 1, ("a", "b"): 2, ("b", "a"): 1, ("a", "c"): 1, ("c", "</s>"): 1}
    pairs |= {("b", "b"): 1, ("b", "</s>"): 1, ("c", "a"): 1, ("a", "</s>"): 1}
    once, seen = sum(c == 1 for c in pairs.values()), sum(pairs.values())
    back = once / seen
    p = {w: (1 - back) * after_a.get(w, 0) / 4 + back * first(w) for w in ["a", "b", "c", "</s>", "unseen"]}
    assert sum(p.values()) == pytest.approx(1)
    start = (1 - back) * 2 / 3 + back * first("a")
    assert 10 ** rows[200] == pytest.approx(start * p["</s>"])


def test_quality_counts(spark, texts):
    rows = [*texts, (-1, None), (-2, ""), (-3, "a b c d e f g h " * 3), (-4, "x\nx\n\n \nx"), (-5, "a " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = quality.with_statistics(df).select("doc_id", *columns)
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == {i: brute.quality_counts(t) for i, t in rows}


def test_quality_rules_follow_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows, rules = quality.decided(docs, labels)
    assert 1 <= len(rules) <= quality.Learning().most_rules
    seen = rows.where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in seen}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)]
    assert n.get((0, False), 0) >= 0.8 * (n.get((0, True), 0) + n.get((0, False), 0))
    plan = rows._jdf.queryExecution().toString()
    assert not PYTHON.search(plan)


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, "a " * 30), (None, "b c " * 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 0), (1, 1)], "doc_id long, quality int")
    rows, rules = quality.decided(docs, labels)
    assert rules == [] and rows.count() == 3
    assert {r.kept for r in rows.where("n_words = 0").collect()} == {False}
    rows, rules = quality.decided(docs.limit(0), labels.limit(0))
    assert rules == [] and rows.count() == 0


def test_covering_prefers_precise_rules(spark):
    """A conjunction is needed: bad texts are long and without capitals."""
    long_low, long_up = "abc def " * 40, "Abc Def " * 40
    short_low = "abc def " * 12
    rows = [(i, [long_low, long_up, short_low][i % 3] + f"w{i} v{i}") for i in range(240)]
    unique = [(i, " ".join(f"{w}{k}" for k, w in enumerate(t.split()))) for i, t in rows]
    docs = spark.createDataFrame(unique, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(240)], "doc_id long, quality int")
    out, rules = quality.decided(docs, labels)
    assert any(len(r.conditions) == 2 for r in rules)
    assert {(r.doc_id % 3 == 0, r.kept) for r in out.collect()} == {(True, False), (False, True)}


def test_chat_equals_sql(spark):
    df = queries.op9(spark, SF_DIR)
    assert diff(df, connect(SF_DIR), queries.OP9_SQL) is None
    assert not PYTHON.search(df._jdf.queryExecution().toString())


def test_chat_reads_back_and_orders(spark):
    rows = [
        (1, 0, "user", None),
        (1, 1, "tool<text>", "a\\[INST]\\\\</s><text>\n</turn>"),
        (1, 2, "assistant", "<<s>x\\"),
        (2, 1, "assistant", "z<"),
        (2, 0, "user", "</s>[INST] ok [/INST]"),
        (3, 0, "system", ""),
        (None, None, None, ""),
        (4, 0, "user", "q"),
        (4, 0, "user", "q"),
    ]
    df = spark.createDataFrame([(*r, "") for r in rows], "conv_id long, turn long, role string, text string, t string")
    out = chat.formatted(df).withColumn("back", chat.read_back(F.col("formatted")))
    got = {r.conv_id: ([tuple(t) for t in r.back], r.valid, r.wrong_turn) for r in out.collect()}
    assert got[1] == ([("user", ""), (rows[1][2], rows[1][3]), ("assistant", "<<s>x\\")], False, 1)
    assert got[2] == ([("user", rows[4][3]), ("assistant", "z<")], True, None)
    assert got[3] == ([("system", "")], False, None)
    assert got[None] == ([("", "")], False, 0)
    assert got[4] == ([("user", "q"), ("user", "q")], False, 1)
    assert chat.formatted(df.limit(0)).count() == 0


def test_query_runs_the_machine(spark, tmp_path):
    """Conversations in and out of order through the registered query; its plan holds the fold."""
    talk = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "ho"),
        (2, 0, "assistant", "first"), (2, 1, "user", "</s>"), (2, 2, "assistant", None), (2, 3, "user", "x"),
        (3, 0, "user", "a"), (3, 1, "user", "b"), (3, 2, "tool", "c\\"), (3, 3, "assistant", "d"), (3, 3, "assistant", "d"),
        (4, 0, None, "e"), (5, 0, "system", "s"), (5, 1, "system", "s"), (None, 0, "assistant", "n"), (6, None, "user", "u"),
    ]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op9(spark, str(tmp_path))
    assert diff(out, connect(str(tmp_path)), queries.OP9_SQL) is None
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and all(state in plan for state in ("instructed", "asked", "answered", "error"))


def test_states_decide_the_marks(spark):
    """A template in which the same role is marked by its state, and long conversations."""
    two = chat.Template(
        {"q": chat.Turn("[Q]", "(/Q)"), "a": chat.Turn("{A}", "<A>", loss=True)}, "begin",
        {("begin", "q"): "asked", ("asked", "a"): "done"}, frozenset({"done"}), other=chat.Turn("|T-", "~T-"), role_end="^:",
    )
    rows = [(1, i, r, str(i)) for i, r in enumerate(["q", "a", "a", "z"])]
    rows += [(2, i, "qa"[i % 2], str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.formatted(df, two).collect()}
    assert got[1].formatted == "[Q]0(/Q){A}1<A>{A}2<A>|T-z^:3~T-" and (got[1].valid, got[1].wrong_turn) == (False, 2)
    assert [s.loss for s in got[1].segments] == [False] * 4 + [True, False] + [False, True, False] + [False] * 3
    assert got[2].n_turns == 3000 and got[2].wrong_turn == 2 and got[2].formatted.count("{A}") == 1500
    with pytest.raises(ValueError):
        chat.Template({"q": chat.Turn("[Q", "(Q"), "a": chat.Turn("{A", "<A")}, "s", {("s", "q"): "t", ("s", "a"): "t"}, frozenset())


def test_chat_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template({"user": chat.Turn("<a<", "<b")}, "s", {}, frozenset())


def test_warc_equals_sql(spark):
    assert diff(queries.op3(spark, SF_DIR), connect(SF_DIR), queries.OP3_SQL) is None


def test_warc_edge_rows(spark):
    rows = [(1, "u\r\nx: y", "same"), (2, "v", "same"), (3, None, None), (4, "", ""), (None, "n", "same"), (2, "v", "same"), (9, "q", "é\r\n\r\nWARC/1.1" * 5000)]
    df = spark.createDataFrame([(*r, "") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id, r.record_type, r.refers_to, bytes(r.payload or b"")) for r in warc.archived(df, "d").collect()), key=str)
    want = [(1, "revisit", 2, b""), (2, "response", None, b"same"), (2, "response", None, b"same"), (3, "revisit", 4, b"")]
    want += [(4, "response", None, b""), (None, "revisit", 2, b""), (9, "response", None, rows[6][2].encode())]
    assert got == sorted(want, key=str)
    assert warc.archived(df.limit(0), "d").count() == 0


def test_warc_reader_verifies(spark):
    record = warc.record(7, "u", b"body", warc.base32_sha1(b"body"), None, False, "d")
    two = warc.gzip_member(record) + warc.gzip_member(record)
    assert [warc.parsed(m)["page_id"] for m in warc.members(io.BytesIO(two))] == [7, 7]
    assert gzip.decompress(two) == record * 2
    with pytest.raises(warc.WarcError, match="digest"):
        warc.parsed(record.replace(b"body", b"bodx"))
    with pytest.raises(warc.WarcError, match="Content-Length"):
        warc.parsed(record[:-3])
    with pytest.raises(warc.WarcError, match="inside"):
        list(warc.members(io.BytesIO(two[:-5])))


def test_warc_files_are_plain_archives(spark):
    root = shared_dir(spark, "warc-test")
    df = spark.createDataFrame([(1, "u", "x"), (2, "v", "y")], "page_id long, url string, html string")
    manifest = warc.write_archives(df, root, "d").collect()
    assert sum(r.n_records for r in manifest) == 2
    assert all(gzip.open(r.path).read().startswith(b"WARC/1.1\r\n") for r in manifest)


def article(page):
    m = re.search(r"<article[^>]*>(.*?)(?:</article>|\Z)", page, re.S)
    inner = re.sub(r"<!--.*?-->", "", m[1], flags=re.S)
    blocks = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", "\x00", inner)).split("\x00")
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_article_texts(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op4(spark, SF_DIR).collect()}
    assert {i: r.text for i, r in got.items()} == {i: article(p.html) for i, p in pages.items()}
    assert all(r.n_chars == len(r.text) and r.url == pages[i].url for i, r in got.items())


PAGE = """<html><head><title>t</title></head><body class="has-sidebar"><header><div id="menu">Home | About</div></header>
<div class="cookie-notice">We use cookies</div><div class="top">Same on all pages</div>
<div id="main-col"><h1>Title %d</h1><p>First &amp; <b>bo</b>ld %d<br>line.<p>Second&nbsp;para <span class="ad">BUY</span> of %d</p>
<ul><li>one %d<li>two</ul><div class="comments"><p>Nice!</p></div><form><label>Mail</label><input></form></div>
<aside>side</aside><script>var x = "<p>no</p>";</script><!-- <p>no</p> --><footer>foot</footer></body></html>"""


def test_template_without_article_element(spark):
    rows = [(i, f"http://h.example/{i}", PAGE % (i, i, i, i)) for i in range(6)]
    rows += [(10, None, None), (None, "http://q/", ""), (11, "bad://[x", "<p>a<p>b &lt;x&gt; < 3 <notatag"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, "") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html_text.extracted(df).collect()}
    for i in range(6):
        assert got[i] == f"Title {i}\nFirst & bold {i} line.\nSecond para of {i}\none {i}"
    assert got[10] == "" and got[None] == "" and got[11] == "a\nb <x> < 3 <notatag"
    assert html_text.extracted(df.limit(0)).count() == 0


def test_classes_nest():
    vectors = [("/html", 4, 1, 50), ("/html/body", 4, 1, 50), ("/html/body/main", 4, 2, 40), ("/other/x", 4, 3, 0), ("/html/body#t", 4, 1, 0)]
    plan = html_text.template([("", 4, 0, 0), *vectors, ("/html/body/rare", 1, 9, 0)], 4)
    assert plan["root"] == "/html/body/main" and plan["texts"] == ["/html/body#t"]
    assert "/other/x" not in plan["paths"] and "/html/body/rare" not in plan["paths"]


def test_repeated_passages_of_articles_stay(spark):
    page = "<html><body><nav>menu</nav><article><h1>T</h1><p>same passage</p><p>own %d</p></article></body></html>"
    df = spark.createDataFrame([(i, "http://a.example/", page % i) for i in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extracted(df).collect()} == {i: f"T\nsame passage\nown {i}" for i in range(8)}


def texts_of(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.extracted(df).collect()}


@pytest.mark.parametrize("name", ["page has-sidebar", "no-ads", "social-layout", "content-widget"])
def test_wrappers_of_articles_stay(spark, name):
    page = f'<html><body><nav>menu</nav><div class="{name}"><article><h1>T%d</h1><p>text %d</p></article><p class="share">Share</p></div></body></html>'
    rows = [(i, "http://a.example/", page % (i, i)) for i in range(4)] + [(9, "http://alone.example/", page % (9, 9))]
    assert texts_of(spark, rows) == {i: f"T{i}\ntext {i}" for i in (0, 1, 2, 3, 9)}


def test_class_words_need_the_template(spark):
    """An advert on every page is left out; a section that one page names alike stays."""
    page = '<html><body><article><p>text %d <span class="ad">BUY %d</span></p>%s</article></body></html>'
    own = ['<section id="related-work"><h2 id="social-history">Work</h2><p>real</p></section>', "", "", '<p id="comments-on-method">method</p>']
    got = texts_of(spark, [(i, "http://a.example/", page % (i, i, own[i])) for i in range(4)])
    assert got == {0: "text 0\nWork\nreal", 1: "text 1", 2: "text 2", 3: "text 3\nmethod"}


def test_most_of_the_changing_text_is_no_boilerplate(spark):
    page = '<html><body><div class="menu">Home</div><div class="social-main"><p>long and changing text %d</p></div></body></html>'
    got = texts_of(spark, [(i, "http://a.example/", page % i) for i in range(4)] + [(9, None, page % 9)])
    assert got == {i: f"long and changing text {i}" for i in (0, 1, 2, 3, 9)}


def test_copies_make_no_template(spark):
    """Three copies among six pages of a host without article elements, and a near copy each."""
    page = '<html><body><div class="top">Same everywhere</div><div id="col"><p>para a%s of the article</p><p>para b%s</p></div>%s</body></html>'
    rows = [(i, "http://a.example/", page % (i // 3 * i, i // 3 * i, "")) for i in range(6)]
    rows += [(10 + i, "http://near.example/", page % (i // 3 * i, i // 3 * i, f"<footer>{i}</footer>")) for i in range(6)]
    want = {i: f"para a{i // 3 * i} of the article\npara b{i // 3 * i}" for i in range(6)}
    assert texts_of(spark, rows) == want | {10 + i: t for i, t in want.items()}


NOTICE = """<html><body><nav>menu</nav><article><h1>Title %d</h1><p>An own paragraph, number %d, long enough to be one.</p>
<div class="box"><p>Our readers pay for this site.</p><p>Join them.</p></div><section><p>Shared passage.</p><p>More of %d.</p></section>
</article></body></html>"""


def test_unlisted_notice_inside_articles_goes(spark):
    """The notice's element holds nothing else on any page; the shared passage stands where texts change."""
    rows = [(i, "http://a.example/", NOTICE % (i, i, i)) for i in range(5)] + [(9, "http://alone.example/", NOTICE % (9, 9, 9))]
    want = "Title {0}\nAn own paragraph, number {0}, long enough to be one.\n{1}Shared passage.\nMore of {0}."
    got = texts_of(spark, rows)
    assert got == {i: want.format(i, "") for i in range(5)} | {9: want.format(9, "Our readers pay for this site.\nJoin them.\n")}


def test_near_copies_of_one_article_stay_whole(spark):
    page = "<html><body><main><div class='lead'><p>The lead of it.</p></div><p>First part of the article.</p><p>Second part, copy %d.</p></main></body></html>"
    got = texts_of(spark, [(i, "http://a.example/", page % i) for i in range(5)])
    assert got == {i: f"The lead of it.\nFirst part of the article.\nSecond part, copy {i}." for i in range(5)}


def test_unclosed_quote_ends_its_tag():
    assert html_text.main_text('<p>a <b "x>one</b> two</p>') == "a one two"
    assert html_text.main_text("<p title='x > y'>one</p><p>two") == "one\ntwo"


HOSTILE = {
    "quotes": '<a "' * 250_000 + ">",
    "two quotes": "<a '<b \"" * 125_000 + "> x",
    "blocks": "<div>" * 200_000 + "deep",
    "marked": '<div class="ad">x' * 60_000,
    "inline": "<b>x" * 250_000,
    "articles": '<article><div class="ad">x' * 40_000,
    "closing": "<b><div>" + "<i>x" * 100_000 + "</b>" * 100_000,
    "bodies": "<head><body>" * 80_000,
    "names": '<p class="' + "ab cd " * 160_000 + '">' + "<p>z" * 100,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_work_follows_the_length_of_hostile_pages(name):
    """1 MB each: minutes to days where any step goes by the square."""
    begun = time.process_time()
    found = html_text.occurrences(HOSTILE[name])
    html_text.main_text(HOSTILE[name])
    assert time.process_time() - begun < 60
    assert sum(map(len, found)) < 100 * len(HOSTILE[name])


def test_memory_of_deep_pages():
    tracemalloc.start()
    html_text.occurrences("<div>" * 50_000 + "deep")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20


def test_deep_host_equals_its_pages(spark):
    """Long paths are named by digests; template and root are found below them."""
    page = "<html><body><nav>m</nav>" + '<div class="wrapping-column">' * 60 + "<p>text %d</p><p>Same</p>" + "</div>" * 60 + "<div>foot</div></body></html>"
    got = texts_of(spark, [(i, "http://a.example/", page % i) for i in range(4)])
    assert got == {i: f"text {i}" for i in range(4)}


def test_texts_of_5_mb(spark):
    """Archives, statistics and chats of one text of 5 MB each, in closed form."""
    n = 700_000
    long = " ".join(f"w{i}" for i in range(n))
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, len(r.payload or b"")) for r in warc.archived(pages, "d").collect()}
    assert got == {1: ("revisit", 2, 0), 2: ("response", None, len(long))}

    docs = spark.createDataFrame([(1, long), (2, "# a\n" * n)], "doc_id long, text string")
    rows = quality.with_statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {tuple(r) for r in rows.collect()} == {(1, n, len(long) - n + 1, 0, 0, 0), (2, 2 * n, 2 * n, n, n - 1, 2 * n)}

    turns = [(1, 0, "user", "</s>" + long), (1, 1, "assistant", long)]
    out = chat.formatted(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    row = out.withColumn("loss", chat.loss_text(F.col("segments"))).first()
    assert row.n_turns == 2 and row.valid and row.loss == long
