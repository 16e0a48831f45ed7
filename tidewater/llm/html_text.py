"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: a tag with the path of tags that it stands in, and a
text with its path.  Over the pages of one host each token has an occurrence
vector (how often it occurs on each page); tokens with the same vector form an
equivalence class.  Classes that occur on at least half of the pages are valid
when their tokens nest: a token's path continues a path that a valid class holds
already.  The valid classes, nested, are the host's template; what lies between
its tokens are slots.  Texts that belong to a class are the template's own
(menus, notices); the slots below the template's content root hold the article.
The root is the template's article or main element, or else the deepest path
that holds most of the host's changing text.

Inside a marked article the class of the root decides: a text that occurs with
the same vector as the root is the template's if no text at its path, or below
it, has another vector.  So a notice in an element of its own goes, and a
passage that articles share stays where the path changes elsewhere.  Headings
and paragraphs directly below an article stay always.  Where most of the text
beside such notices has the root's vector as well, the host's pages are near
copies of one article, which tell nothing, and all of it stays.
Slots inside the root that stand in menus, adverts, forms, comments and the like
are left out, by element, role or class name.  A class or id name counts only
where the template agrees: the element's path is one of the template's, holds no
article or main and not most of the host's changing text.  On a page without
template it counts outside of marked articles, unless most of the page is in it.

Each distinct content counts as one page of its host, so copies make no template.
Vectors are never gathered: a token's vector is the exclusive or of a hash of
(content, count), which tasks add up per batch and Spark adds up per host, so a
host with a third of all pages is spread like any other.  A template holds
tokens of at least half of its host's pages, hence no more than twice what a
page has.  Hosts with fewer than PAGES distinct pages, pages without host
and pages that lack the host's root are read by their own article or main
element, or else whole.  Where nothing but texts of the template stands under
the root, these are the page's text.

Work and memory follow the page's length: a tag whose quote never closes ends at
its first ">", at most three searches for such an end reach the page's end, open
elements are found by their tag, a long path is named by its digest, and sizes
are added up once, from the leaves.

Defined results: a null html is empty and has the empty text; ids play no part;
ties between paths go to the first in order; an empty table gives no rows.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialised, text_or_empty, when_small

PAGES = 3  # pages from which on a host has a template
SHARE = 2  # a class occurs on one page in so many at least
MOST = 0.6  # share of the changing text that a path must hold to be gone into

LONG = 200  # characters from which on a path or a label is named by its digest

START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.S)  # comment, declaration or the like
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
TAG = re.compile(NAME.pattern + "(" + QUOTED.pattern + ")>")
QUOTES = re.compile(r"\"[^\"]*+\"?|'[^']*+'?")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMES = re.compile(r"[A-Za-z]+")

RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param keygen".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section"
    " summary table tbody td tfoot th thead tr ul head title".split()
)
CONTENT = frozenset({"article", "main"})
BOILERPLATE = frozenset(
    "head nav footer aside form script style noscript template iframe svg math button select textarea input dialog menu"
    " canvas object audio video map".split()
)
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie"
    " cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead toolbar topbar share sharing social related"
    " recommended recommendations teaser teasers comment comments commentlist reply replies respond disqus widget login"
    " pagination pager footer copyright".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
# What an article element itself may be called and still be no article.
NOT_ARTICLE = frozenset("ad ads advert sponsored promo comment comments reply replies teaser related".split())
# A tag that is opened inside one of these ends it first.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol table tbody thead tfoot dl select article main section div body nav aside footer header form".split())


class Element:
    """An open tag.  ``mark`` is the innermost element, itself included, that a class word
    marks, ``outer`` the next one around that; ``near`` the innermost block; ``holder`` the
    innermost element that texts belong to; ``scope`` the place of the innermost scope."""

    __slots__ = ("tag", "path", "bad", "content", "parent", "mark", "outer", "holds", "near", "holder", "place", "scope", "under")

    def __init__(self, tag: str, path: str, bad: bool, content: bool, parent: Element | None = None, marked: bool = False):
        self.tag, self.path, self.bad, self.content, self.parent = tag, path, bad, content, parent
        around = parent.mark if parent else None
        self.mark, self.outer = (self, around) if marked else (around, None)
        self.holds = False  # an article or main, which is known once the page is read
        self.near = self if tag in BLOCK else parent.near if parent else None
        self.holder = self if bad or content or tag in BLOCK else parent.holder if parent else None
        self.place = self.scope = 0
        self.under: bool | None = None  # below the template's root


def attributes(text: str) -> dict[str, str]:
    return {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(text)}


def short(name: str) -> str:
    """A path as it stands in the paths below it."""
    return name if len(name) <= LONG else "~" + xxhash.xxh64_hexdigest(name)


def element(tag: str, attrs: str, parent: Element) -> Element:
    found = attributes(attrs) if attrs.strip(" /\n\t\r") else {}
    names = {w.lower() for k in ("class", "id") for w in NAMES.findall(found.get(k, ""))}
    role = found.get("role", "").lower()
    marked = False
    if tag in CONTENT:
        bad = bool(names & NOT_ARTICLE)
    elif tag in ("html", "body"):
        bad = False
    elif tag == "header":  # an article's own header belongs to it
        bad = not parent.content
    else:
        bad = tag in BOILERPLATE or role in ROLES
        marked = not bad and bool(names & CLASSES)
    label = tag.replace("#", "~") + "".join("." + n for n in sorted(names))
    if len(label) > LONG:
        label = ".".join([tag[:20].replace("#", "~"), *sorted(names & NOT_ARTICLE), "~" + xxhash.xxh64_hexdigest(label)])
    content = not (parent.bad or bad) and (parent.content or tag in CONTENT or role in ("main", "article"))
    if tag in CONTENT and content:
        e = parent.mark
        while e is not None and not e.holds:
            e.holds = True
            e = e.outer
    return Element(tag, f"{short(parent.path)}/{label}", parent.bad or bad, content, parent, marked)


Parts = list[tuple[Element, Element, str]]


def leaving(left: Callable[[Element], bool]) -> Callable[[Element], bool]:
    """Whether an element stands in a marked one that is left out; each is asked once."""
    known: dict[int, bool] = {}

    def out(e: Element) -> bool:
        asked, m = [], e.mark
        while m is not None and id(m) not in known:
            if not m.holds and left(m):
                known[id(m)] = True
                break
            asked.append(m)
            m = m.outer
        found = m is not None and known[id(m)]
        for x in asked:
            known[id(x)] = found
        return found

    return out


def composed(parts: Parts, out: Callable[[Element], bool] | None = None) -> str:
    """A block's text without the parts that are left out; white space is folded and
    references are decoded."""
    kept = [t for _, e, t in parts if out is None or e.mark is None or not out(e)]
    return " ".join(html.unescape("".join(kept)).split())


def unnamed(parts: Parts) -> str:
    """A block's text as its token has it: without marked parts if others are there."""
    return composed(parts, lambda e: not e.mark.holds) or composed(parts)


class Tags:
    """Finds a page's tags, each character being looked at a bounded number of times.

    Quotes of two kinds only swap the states "outside", "in double" and "in single quotes",
    so searches for a tag's end follow one of three traces; a trace that found no end is
    known by the quotes that it opened and is not followed again."""

    def __init__(self, page: str):
        self.page, self.last, self.endless = page, page.rfind(">"), set()

    def end(self, at: int) -> int:
        """Place of the ">" that ends a tag whose attributes begin at ``at``."""
        first = self.page.find(">", at)
        quotes = [q for q in (self.page.find(c, at, first) for c in "\"'") if q >= 0]
        if not quotes or min(quotes) in self.endless:
            return first
        found = QUOTED.match(self.page, at).end()
        if found <= self.last and self.page[found] == ">":
            return found
        self.endless.update(m.start() for m in QUOTES.finditer(self.page, min(quotes)))
        return first

    def next(self, at: int) -> tuple[int, int, str, str | None, str] | None:
        """(start, end, "/" of an end tag, name, attributes); the name of what is no tag is None."""
        while m := START.search(self.page, at):
            start = m.start()
            if m[0] in ("<!", "<?"):
                return start, ASIDE.match(self.page, start).end(), "", None, ""
            if start < self.last:
                whole = not self.endless and TAG.match(self.page, start)
                if whole:
                    return start, whole.end(), whole[1], whole[2].lower(), whole[3]
                name = NAME.match(self.page, start)
                end = self.end(name.end())
                return start, end + 1, name[1], name[2].lower(), self.page[name.end() : end]
            at = self.page.find("<!", start + 1)  # no tag ends any more
            other = self.page.find("<?", start + 1)
            at = min((x for x in (at, other) if x >= 0), default=len(self.page))
        return None


def read(page: str) -> Iterator[tuple[str, Element, Parts]]:
    """("tag", element, []) for each start tag and ("text", element, parts) for each block
    of text outside of boilerplate; parts are (block element, innermost element, text)."""
    root = Element("", "", False, False)
    stack = [root]
    places: dict[str, list[int]] = {}  # where the open elements of a tag are in the stack
    parts: Parts = []
    tags = Tags(page)
    at = 0

    def block() -> list[tuple[str, Element, Parts]]:
        own = parts.copy()
        parts.clear()
        return [("text", own[0][0], own)] if any(t and not t.isspace() for _, _, t in own) else []

    def opened(e: Element) -> None:
        e.place = len(stack)
        e.scope = e.place if e.tag in SCOPE else stack[-1].scope
        places.setdefault(e.tag, []).append(e.place)
        stack.append(e)

    def cut(place: int) -> None:
        for e in stack[place:]:
            places[e.tag].pop()
        del stack[place:]

    n = len(page)
    headless = False
    while at < n:
        m = tags.next(at)
        piece = page[at : m[0]] if m else page[at:]
        if piece:
            here = stack[-1].holder or stack[-1]  # inline elements belong to the block around them
            if not here.bad:  # what is left out takes no part in blocks
                parts.append((here, stack[-1], piece))
        if not m:
            break
        _, at, closing, tag, attrs = m
        if tag is None:
            continue
        if closing:
            if tag in BLOCK:
                yield from block()
            if places.get(tag) and (tag in BLOCK or stack[-1].scope <= places[tag][-1]):
                cut(places[tag][-1])
            continue
        if tag == "br":
            if parts:  # something of the block came already
                parts.append((parts[0][0], stack[-1], " "))
            continue
        if tag in BLOCK:
            yield from block()
            ends = ENDS.get(tag) or ({"p"} if tag not in ("html", "body", "head") else set())
            place = max((places[t][-1] for t in ends if places.get(t)), default=0)
            if place > stack[-1].scope:
                cut(place)
        if tag == "body" and not headless:  # the head ends
            headless = True
            kept = [e for e in stack[1:] if e.tag != "head"]
            cut(1)
            for e in kept:
                opened(e)
        own = element(tag, attrs, stack[-1])
        yield "tag", own, []
        if tag in RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            opened(own)
    yield from block()


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").rstrip(".")
    except ValueError:
        return ""


def text_token(e: Element, text: str) -> str:
    """A text at its path.  Texts of marked articles stand at their block: "#=" before those
    that always stay (directly in an article, or its headings and paragraphs), "#+" before others."""
    kind = ""
    if e.content:
        e = e.near if e.near is not None and e.near.content else e
        tops = [x for x in (e, e.parent) if x.tag in CONTENT or not x.parent or not x.parent.content]
        kind = "=" if tops and (tops[0] is e or e.tag in PROSE) else "+"
    return f"{e.path}#{kind}{xxhash.xxh64_hexdigest(text)}"


def occurrences(page: str) -> dict[str, list[int]]:
    """Token to [times it occurs, characters of text below it]; "!" and a path stand for
    the elements of that path that a class word marks and that hold no article or main."""
    out: dict[str, list[int]] = {}
    above: dict[str, str] = {}  # path to the path around it, outer ones first
    marks: dict[int, int] = {}  # characters of text in a marked element
    marked: list[Element] = []  # outer ones first
    for kind, e, parts in list(read(page)):  # what an element holds is known at the end
        if kind == "tag":
            above.setdefault(e.path, e.parent.path)
            out.setdefault(e.path, [0, 0])[0] += 1
            if e.mark is e:
                marked.append(e)
                if not e.holds:
                    out.setdefault("!" + e.path, [0, 0])[0] += 1
            continue
        text = composed(parts)
        own = out.setdefault(text_token(e, unnamed(parts) if any(x.mark for _, x, _ in parts) else text), [0, 0])
        own[0] += 1
        own[1] += len(text)
        for _, inner, piece in parts:
            if inner.mark:
                marks[id(inner.mark)] = marks.get(id(inner.mark), 0) + len(piece.strip())
        if e.path:
            out[e.path][1] += len(text)
    for path, around in reversed(above.items()):
        if around:
            out[around][1] += out[path][1]
    for e in reversed(marked):
        size = marks.get(id(e), 0)
        if size and not e.holds:
            out["!" + e.path][1] += size
        if size and e.outer:
            marks[id(e.outer)] = marks.get(id(e.outer), 0) + size
    return out


VECTORS = "host string, token string, pages long, vector long, chars long"
_VECTORS = pa.schema(
    [("host", pa.string()), ("token", pa.string()), ("pages", pa.int64()), ("vector", pa.int64()), ("chars", pa.int64())]
)


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's share of the occurrence vectors, by (host, token), from (host, digest, page);
    "" counts the pages."""
    for batch in batches:
        held: dict[tuple[str, str], list[int]] = {}
        for host, digest, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for token, (times, chars) in [("", [1, 0]), *occurrences(page).items()]:
                if not times:  # only text below a tag that another path token stands for
                    continue
                own = held.setdefault((host, token), [0, 0, 0])
                own[0] += 1
                own[1] ^= xxhash.xxh64_intdigest(f"{digest} {times}")
                own[2] += chars
        rows = [(h, t, p, v - (1 << 64) if v >> 63 else v, c) for (h, t), (p, v, c) in held.items()]
        for i in range(0, len(rows), 10_000):
            part = list(zip(*rows[i : i + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, _VECTORS)], schema=_VECTORS)


def template(tokens: list[tuple[str, int, int, int]], pages: int) -> dict:
    """Template of a host from (token, pages, vector, chars): valid classes, nested.

    ``paths`` and ``texts`` are the tokens of valid classes, ``root`` the path of the
    content root (empty if there is none), ``left`` the paths that their class names
    leave out, ``fixed`` the texts inside marked articles that belong to the root's class.
    """
    classes: dict[str, tuple[int, int]] = {}  # token to its equivalence class
    chars, marks = {"": 0}, {}
    below: dict[str, list[str]] = {}  # paths and texts that continue a path
    for token, support, vector, size in sorted(tokens):
        if token.startswith("!"):
            if support * SHARE >= pages:
                marks[token[1:]] = size
        elif token and support * SHARE >= pages:
            classes[token] = (support, vector)
            chars[token] = size
            below.setdefault(token.rpartition("#" if "#" in token else "/")[0], []).append(token)
    # Classes nest from the page inwards: a path's tokens continue the template once it holds the path.
    held, around, depth = [""], {"": ""}, {"": 0}
    texts: list[str] = []
    for p in held:
        texts += [t for t in below.get(p, []) if "#" in t]
        for q in below.get(short(p), []):
            if "#" not in q:
                held.append(q)
                around[q], depth[q] = p, depth[p] + 1

    def summed(sizes: dict[str, int]) -> dict[str, int]:
        out = dict.fromkeys(held, 0) | sizes
        for p in reversed(held[1:]):
            out[around[p]] += out[p]
        return out

    def at_paths(some: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        for t in some:
            out[t.partition("#")[0]] = out.get(t.partition("#")[0], 0) + chars[t]
        return summed(out)

    inner = [t for t in texts if t.partition("#")[2][0] in "=+"]
    texts = [t for t in texts if t.partition("#")[2][0] not in "=+"]
    constant = at_paths(texts)
    sizes = {p: chars[p] for p in held}
    changing = max((chars[p] for p in held[1:]), default=0) - constant[""]
    left, inside = set(), set()
    for p in held[1:]:
        if p in marks:
            own = marks[p] - constant[p]
            # Most of the host's changing text is no boilerplate, whatever it is called.
            if own <= 0 or own < MOST * changing:
                left.add(p)
        if p in left or around[p] in inside:
            inside.add(p)
    # Characters that are left out hold no root.
    outermost = {}
    for p in left:
        if around[p] not in inside:
            outermost[around[p]] = outermost.get(around[p], 0) + marks[p]
    gone = summed(outermost)
    for p in held[1:]:
        if p not in inside:
            chars[p] -= gone[p]
    marked = [p for p in held[1:] if p.rpartition("/")[2].partition(".")[0] in CONTENT]
    marked = [p for p in marked if not set(p.rpartition("/")[2].split(".")[1:]) & NOT_ARTICLE and chars[p]]
    fixed: list[str] = []
    if marked:
        root = min(marked, key=lambda p: (-chars[p], depth[p], p))
        common = [t for t in inner if classes[t] == classes[root]]
        still = at_paths([t for t in common if "#+" in t])
        fixed = [t for t in common if "#+" in t and still[t.partition("#")[0]] == sizes[t.partition("#")[0]]]
        rest = sizes[root] - sum(chars[t] for t in fixed)
        if 2 * sum(chars[t] for t in common if t not in set(fixed)) >= rest:
            fixed = []
    else:
        root, total = "", max((chars[p] for p in held[1:] if p not in inside), default=0)
        while total:
            next_ = [p for p in below.get(short(root), []) if "#" not in p and p not in inside and chars[p] >= MOST * total]
            if not next_:
                break
            root = min(next_, key=lambda p: (-chars[p], p))
    return {"root": root, "texts": sorted(texts), "paths": sorted(held[1:]), "left": sorted(left), "fixed": sorted(fixed)}


def alone(found: list[tuple[Element, Parts]]) -> Callable[[Element], bool]:
    """What class words leave out of a page without template."""
    total, below, marked = 0, {}, {}
    for _, parts in found:
        for _, inner, piece in parts:
            size = len(piece.strip())
            total += size
            e = inner.mark
            if e:
                below[id(e)] = below.get(id(e), 0) + size
            while e and id(e) not in marked:
                marked[id(e)] = e
                e = e.outer
    for e in sorted(marked.values(), key=lambda e: -e.place):  # inner ones first
        if e.outer:
            below[id(e.outer)] = below.get(id(e.outer), 0) + below[id(e)]
    return lambda e: not e.content and below.get(id(e), 0) < MOST * total


def stands_in(e: Element, root: str) -> bool:
    """Whether an element is the root or below it; each element is asked once."""
    asked: list[Element] = []
    while e.under is None:
        if e.path == root or e.parent is None:
            e.under = e.path == root
            break
        asked.append(e)
        e = e.parent
    for x in asked:
        x.under = e.under
    return bool(e.under)


def main_text(page: str, plan: dict | None = None) -> str:
    """The article's blocks, one per line, from the slots of the host's template."""
    blocks = [(e, parts) for kind, e, parts in read(page) if kind == "text"]
    if plan and "constant" not in plan:
        plan["constant"], plan["left"] = frozenset(plan["texts"] + plan["fixed"]), frozenset(plan["left"])
    out = leaving((lambda e: e.path in plan["left"]) if plan else alone(blocks))
    found = [(e, t, parts) for e, parts in blocks if (t := composed(parts, out))]
    own = [(e, t, x) for e, t, x in found if e.content]
    if plan and plan["root"]:
        asked = bool(plan["fixed"])

        def fresh(rows: list[tuple[Element, str, Parts]]) -> list[str]:
            """Texts that are not the template's; all of them if there is nothing else."""
            kept = [t for e, t, x in rows if e.content and not asked or text_token(e, unnamed(x)) not in plan["constant"]]
            return kept or [t for _, t, _ in rows]

        slots, articles = fresh([r for r in found if stands_in(r[0], plan["root"])]), fresh(own)
        # A page may hold its article beside the place that the template gives it.
        if slots or articles:
            return "\n".join(slots if len(slots) >= len(articles) else articles)
    return "\n".join(t for _, t, _ in own or found)


def distinct_contents(pages: DataFrame) -> DataFrame:
    """(host, digest, page) of each content of a host, once.  Only contents that occur
    more often on a host are shuffled, one of them per task."""
    keyed = pages.where("host <> ''").select("host", F.sha1("page").alias("digest"), "page")
    often = materialised(keyed.groupBy("host", "digest").count().where("count > 1").drop("count"), "html-copies")
    often = when_small(often)
    copies = keyed.join(often, ["host", "digest"], "left_semi").groupBy("host", "digest").agg(F.min("page").alias("page"))
    return keyed.join(often, ["host", "digest"], "left_anti").unionByName(copies)


def templates(pages: DataFrame) -> DataFrame:
    """(host, plan): one template per host with enough pages, as JSON."""
    parts = distinct_contents(pages).mapInArrow(vectors, VECTORS)
    tokens = parts.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars")
    )
    tokens = materialised(tokens.where(F.col("pages") >= PAGES), "html-tokens")
    totals = tokens.where(F.col("token") == "").select("host", F.col("pages").alias("total"))
    often = tokens.join(totals, "host").where(F.col("pages") * SHARE >= F.col("total"))

    def nested(table: pa.Table) -> pa.Table:
        rows = [tuple(r[k] for k in ("token", "pages", "vector", "chars")) for r in table.to_pylist()]
        plan = template(rows, table.column("total")[0].as_py())
        return pa.table({"host": [table.column("host")[0].as_py()], "plan": [json.dumps(plan)]})

    return materialised(often.groupBy("host").applyInArrow(nested, "host string, plan string"), "html-templates")


def extracted(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text) for every row."""
    pages = df.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("page")
    )

    @F.arrow_udf("string")
    def host(urls: pa.Array) -> pa.Array:
        return pa.array([host_of(u) for u in urls.to_pylist()], pa.string())

    pages = pages.withColumn("host", host("url"))
    plans = templates(pages)

    @F.arrow_udf("string")
    def text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str, dict] = {}
        for page, plan in batches:
            out = []
            for p, j in zip(page.to_pylist(), plan.to_pylist(), strict=True):
                if j is not None and j not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[j] = json.loads(j)
                out.append(main_text(p, known[j] if j is not None else None))
            yield pa.array(out, pa.string())

    rows = pages.join(when_small(plans), "host", "left")
    return rows.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text("page", "plan").alias("text"))
