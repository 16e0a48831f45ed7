"""Benchmark decontamination by winnowing, all as DataFrame expressions.

Words are hashed; a text's fingerprint is the least K-gram hash of every window
of W consecutive K-grams, with K + W - 1 = the span that has to be found.  So
any shared span of that many words shares a fingerprint.  Documents' and items'
fingerprints meet in an equi-join; each hit is extended to the whole spans that
have this fingerprint as their least: they must agree in the hash of all their
words as well.  Items shorter than the span are one window each.  Their fingerprint
is the gram of the shortest such length that they begin with, and each place of a
document carries this gram and the spans of all short lengths, so that one scan
serves every length and a place meets the join once.  Places whose gram sets no bit
in a table of BITS bits over the short items' grams are left inside the row.  Hashes have 64 bits;
fingerprint and span together tell texts apart.

The benchmark's tables are written first, so that Spark knows their size and
broadcasts them below its threshold; beyond it the joins are adaptive shuffle
joins.  Only rows that hit are grouped by document.

Defined results: a null text has no words; an item without words is no window;
items with equal ids count as one item and a null item id is none that could be
named; rows that share a document id are one document, whose hits are the union
by word place; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import lowered, materialised, text_or_empty

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 13
GRAM = 8
BITS = 1 << 18  # of the table of short items' grams: 32 kB, whatever the benchmark's size
P = "__d_"


def words(text: str | Column) -> Column:
    return F.array_remove(F.split(lowered(text_or_empty(text)), NOT_WORD), "")


def _later(a: str, by: int, f) -> Column:
    """f(x[i], x[i + by]) over an array column; the last ``by`` places meet null."""
    return F.zip_with(F.col(a), F.slice(F.col(a), by + 1, F.size(a) + 1), f)


def _cut(a: str, size: int) -> Column:
    """The places at which ``size`` entries of the words begin."""
    return F.slice(F.col(a), F.lit(1), F.greatest(F.col(P + "n") - (size - 1), F.lit(0)))


def hashed(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` columns, word count and word hashes."""
    out = df.select(*keep, F.transform(words(text_col), lambda w: F.xxhash64(w)).alias(P + "1"))
    return out.withColumn(P + "n", F.size(P + "1"))


def grams(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds ``__d_<size>``: hashes of so many consecutive words at each place, by
    doubling; entries beyond the last whole one mean nothing."""
    reach = 1
    while reach * 2 <= max(sizes):
        df = df.withColumn(f"{P}{reach * 2}", _later(f"{P}{reach}", reach, lambda x, y: F.xxhash64(x, y)))
        reach *= 2
    for size in sizes:
        if size & (size - 1):  # two overlapping grams of the next lower power of two
            part = 1 << (size.bit_length() - 1)
            df = df.withColumn(f"{P}{size}", _later(f"{P}{part}", size - part, lambda x, y: F.xxhash64(x, y)))
    return df


def bit_table(prints: DataFrame) -> Column:
    """Constant array of BITS bits, as longs, in which each ``fingerprint`` sets one."""
    place = F.col("fingerprint").bitwiseAND(F.lit(BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = prints.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit)).collect()  # BITS / 64 at most
    table = ["0"] * (BITS // 64)
    for word, bits in rows:
        table[word] = str(bits)
    return F.split(F.lit(",".join(table)), ",").cast("array<long>")


def has_bit(table: Column, h: Column) -> Column:
    place = h.bitwiseAND(F.lit(BITS - 1))
    word = F.get(table, F.shiftright(place, 6).cast("int"))
    return F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def winnowed(
    df: DataFrame, keep: list[str], span: int, gram: int, short: tuple[int, ...] = (), table: Column | None = None
) -> DataFrame:
    """(keep, fingerprint, start, spans, short): a row per run of neighbouring spans with the
    same least gram hash; ``spans`` holds the hashes of the run's spans.  With ``short``
    lengths, ascending, also a row per place whose gram of the shortest length has a bit in
    ``table``, with that gram as fingerprint and the spans of all of them, null beyond the
    text's end."""
    window = span - gram + 1
    out = grams(df, [gram, span, *short])
    out = out.select(
        *keep,
        P + "n",
        F.col(f"{P}{gram}").alias(P + "m"),
        F.col(f"{P}{span}").alias(P + "s"),
        *[F.col(f"{P}{size}").alias(f"{P}w{size}") for size in short],
    )
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        out = out.withColumn(P + "m", _later(P + "m", step, lambda x, y: F.least(x, y)))
        reach += step
    out = out.withColumn(P + "m", _cut(P + "m", span)).withColumn(P + "s", _cut(P + "s", span))
    m = F.col(P + "m")
    starts = F.filter(
        F.transform(m, lambda h, i: F.when((i == 0) | (F.get(m, i - 1) != h), i)), lambda i: i.isNotNull()
    )
    out = out.withColumn(P + "r", starts)
    run = lambda i, j: F.struct(
        F.get(m, i).alias("fingerprint"),
        i.alias("start"),
        F.slice(F.col(P + "s"), i + 1, F.coalesce(j, F.size(m)) - i).alias("spans"),
        F.lit(False).alias("short"),
    )
    rows = _later(P + "r", 1, run)
    if short:
        place = lambda h, i: F.when(
            has_bit(table, h),
            F.struct(
                h.alias("fingerprint"),
                i.alias("start"),
                F.array(*[F.when(i + size <= F.col(P + "n"), F.get(f"{P}w{size}", i)) for size in short]).alias("spans"),
                F.lit(True).alias("short"),
            ),
        )
        places = F.transform(_cut(f"{P}w{short[0]}", short[0]), place)
        rows = F.concat(rows, F.filter(places, lambda x: x.isNotNull()))
    return out.select(*keep, F.explode(rows).alias("x")).select(*keep, "x.*")


def unfolded(runs: DataFrame, keep: list[str], span: int, short: tuple[int, ...] = ()) -> DataFrame:
    """(keep, fingerprint, start, span, size) of each span of the rows of ``winnowed``."""
    out = runs.select(*keep, "fingerprint", "start", "short", F.posexplode("spans").alias("j", "span"))
    sizes = F.array(*[F.lit(m) for m in short or (span,)])
    return out.where(F.col("span").isNotNull()).select(
        *keep,
        "fingerprint",
        F.when(F.col("short"), F.col("start")).otherwise(F.col("start") + F.col("j")).alias("start"),
        "span",
        F.when(F.col("short"), F.get(sizes, "j")).otherwise(F.lit(span)).alias("size"),
    )


def short_windows(items: DataFrame, keep: list[str], short: tuple[int, ...]) -> DataFrame:
    """(keep, fingerprint, span, size) of each item that is one window of a short length."""
    out = grams(items, list(short))
    whole = F.coalesce(*[F.when(F.col(P + "n") == m, F.get(f"{P}{m}", F.lit(0))) for m in short])
    out = out.where(F.col(P + "n").isin(*short))
    return out.select(
        *keep, F.get(f"{P}{short[0]}", F.lit(0)).alias("fingerprint"), whole.alias("span"), F.col(P + "n").alias("size")
    )


def matched(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """(id, n_words, n_hit, items, hits) for each row of ``documents``: words inside
    benchmark windows, the items that these belong to, and the windows found,
    as (first word, words)."""
    items = hashed(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), ["item"], "text")
    lengths = items.where((F.col(P + "n") > 0) & (F.col(P + "n") < span)).select(P + "n").distinct()
    short = tuple(sorted(r[0] for r in lengths.collect()))  # below ``span`` different values at most
    windows = unfolded(winnowed(items, ["item"], span, gram), ["item"], span).drop("start")
    if short:
        windows = windows.unionByName(short_windows(items, ["item"], short))
    windows = materialised(windows.distinct(), "decontaminate-windows")
    known = windows.select("fingerprint", "span", "size").distinct()
    prints = known.select("fingerprint", (F.col("size") < span).alias("short")).distinct()

    docs = hashed(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], "text")
    table = bit_table(prints.where("short")) if short else None
    runs = winnowed(docs, ["id"], span, gram, short, table).join(prints, ["fingerprint", "short"], "left_semi")
    hits = unfolded(runs, ["id"], span, short).join(known, ["fingerprint", "span", "size"])
    # Written once: two aggregates read it.
    hits = materialised(hits.select("id", "start", "size", "fingerprint", "span"), "decontaminate-hits")

    placed = F.sort_array(F.collect_set(F.struct("start", "size")))
    places = hits.groupBy("id").agg(placed.alias("hits"))
    named = hits.select("id", "fingerprint", "span", "size").distinct().join(windows, ["fingerprint", "span", "size"])
    named = named.groupBy("id").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    named = named.withColumnRenamed("id", "owner")
    both = places.join(named, F.col("id").eqNullSafe(F.col("owner")), "left")
    both = both.select(F.col("id").alias("of"), "hits", "items")

    counted = documents.select(F.col(id_col).alias("id"), F.size(words(text_col)).cast("long").alias("n_words"))
    out = counted.join(both, F.col("id").eqNullSafe(F.col("of")), "left")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))

    def cover(acc: Column, w: Column) -> Column:
        end = w["start"] + w["size"]
        fresh = F.greatest(end - F.greatest(acc["end"], w["start"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["words"] + fresh).alias("words"))

    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce(F.aggregate("hits", zero, cover)["words"], F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("hits", F.array().cast("array<struct<start:int,size:int>>")).alias("hits"),
    )


def contaminated() -> Column:
    """One word in twenty is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
