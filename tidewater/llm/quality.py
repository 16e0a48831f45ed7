"""Quality rules: text statistics and a learned decision list, all as DataFrame expressions.

``with_statistics`` adds counts and ratios of each whole text.  ``learn`` fits a
decision list by sequential covering: a rule grows by the threshold with the
best information gain, is pruned on the other part of the labelled rows, and
covers what it rejects; then the next rule follows.  All labelled rows take
part; the driver sees only counts by (statistic, bin, label), whose number does
not depend on the data.  The rules become one ordered conditional expression.

Defined results: a null text has no words and fails the base rules; a document
without label takes no part in learning; a null label likewise; documents with
repeated rows count as often as they occur; with no labelled row of either kind
the list is empty and only the base rules decide.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialised, text_or_empty

WINDOW = 8
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
PREFIX = "__q_"


def _later(a: str, by: int, f) -> Column:
    """f(x[i], x[i + by]) over an array column; the last ``by`` places meet null."""
    return F.zip_with(F.col(a), F.slice(F.col(a), by + 1, F.size(a) + 1), f)


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and
    ``n_lines, n_distinct, n_upper, n_digits`` to every row; other columns stay.

    A text's arrays live in its own row.  Only texts in which a window occurs
    twice pay for sorting their windows.
    """
    p = lambda n: PREFIX + n
    text = text_or_empty(text_col)
    out = df.withColumn(p("words"), F.array_remove(F.split(text, SPACES), ""))
    out = out.withColumn(p("h"), F.transform(p("words"), lambda x: F.xxhash64(x)))
    both = lambda x, y: F.xxhash64(x, y)
    out = out.withColumn(p("h2"), _later(p("h"), 1, both))
    out = out.withColumn(p("h4"), _later(p("h2"), 2, both))
    windows = F.greatest(F.size(p("words")) - (WINDOW - 1), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = out.select(
        *[c for c in out.columns if c not in (p("h2"), p("h4"), p("words"), p("h"))],
        F.size(p("words")).cast("long").alias("n_words"),
        F.length(F.array_join(p("words"), "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.size(F.array_distinct(p("h"))).cast("long").alias("n_distinct"),
        lines.alias(p("lines")),
        F.slice(_later(p("h4"), 4, both), F.lit(1), windows).alias(p("win")),
    )
    w = F.col(p("win"))
    ordered = F.when(
        F.size(F.array_distinct(w)) < F.size(w),
        F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    )
    out = out.select(
        *[c for c in out.columns if c not in (p("lines"), p("win"))],
        F.size(p("lines")).cast("long").alias("n_lines"),
        (F.size(p("lines")) - F.size(F.array_distinct(p("lines")))).cast("long").alias("n_dup_lines"),
        ordered.alias(p("sorted")),
    )
    s = F.col(p("sorted"))
    same = lambda e, i: F.coalesce(F.get(s, i)["h"] == e["h"], F.lit(False))
    twice = F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1))
    out = out.withColumn(p("sorted"), F.sort_array(F.transform(twice, lambda e: e["i"])))
    steps = _later(p("sorted"), 1, lambda a, b: F.coalesce(F.least(F.lit(WINDOW), b - a), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop(p("sorted"))


def base_failed() -> Column:
    """The fixed rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / b, F.lit(0.0)).cast("double")


def features() -> dict[str, Column]:
    """Statistics that rules may test, by name."""
    c = F.col
    return {
        "words": c("n_words").cast("double"),
        "chars_per_word": _ratio(c("word_chars"), c("n_words")),
        "symbols_per_word": _ratio(c("n_symbols"), c("n_words")),
        "upper_per_char": _ratio(c("n_upper"), c("word_chars")),
        "digits_per_char": _ratio(c("n_digits"), c("word_chars")),
        "repeated_words": _ratio(c("n_repeat_words"), c("n_words")),
        "repeated_lines": _ratio(c("n_dup_lines"), c("n_lines")),
        "words_per_line": _ratio(c("n_words"), c("n_lines")),
        "distinct_words": _ratio(c("n_distinct"), c("n_words")),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool  # value >= threshold, else value < threshold
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; documents that meet it are rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional expression over the statistics: false where a rule rejects."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


@dataclass(frozen=True)
class Learning:
    """Parameters of the covering: quantiles per label that serve as thresholds,
    most rules and conditions, least precision and cover on the pruning rows."""

    quantiles: int = 40
    most_rules: int = 8
    most_conditions: int = 3
    precision: float = 0.95
    cover: int = 5
    prune_share: int = 3  # one row in so many is kept for pruning


def learn(
    statistics: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    how: Learning = Learning(),
) -> list[Rule]:
    """Decision list that rejects what the labels call 0.

    ``statistics`` has the columns of ``with_statistics``; documents that fail
    the base rules are decided already and take no part.
    """
    names = list(features())
    known = labels.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("__id"), (F.col(label_col) == 0).cast("int").alias("bad")
    )
    rows = statistics.where(~base_failed()).select(F.col(id_col).alias("__id"), *[v.alias(n) for n, v in features().items()])
    rows = rows.join(known, "__id").withColumn("prune", F.pmod(F.xxhash64("__id"), F.lit(how.prune_share)) == 0)
    rows = materialised(rows, "quality-labelled")

    shares = [(i + 0.5) / how.quantiles for i in range(how.quantiles)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(n, shares, 10_000).alias(n) for n in names]).collect()
    cuts = {n: sorted({v for r in found for v in r[n]}) for n in names}
    cuts = {n: sorted({*v, *[(a + b) / 2 for a, b in zip(v, v[1:])]}) for n, v in cuts.items()}

    def bin_of(n: str) -> Column:  # how many thresholds the value reaches
        return F.size(F.filter(F.array(*[F.lit(float(t)) for t in cuts[n]]), lambda t: t <= F.col(n)))

    if not found or not any(cuts.values()):
        return []
    rules: list[Rule] = []
    while len(rules) < how.most_rules:
        left = rows.where(~reduce(lambda a, b: a | b, [_on(r) for r in rules])) if rules else rows
        rule = _grow(left.where("not prune"), names, cuts, bin_of, how)
        rule = _prune(left.where("prune"), rule, how) if rule else None
        if rule is None:
            break
        rules.append(rule)
    return rules


def _on(rule: Rule) -> Column:
    """The rule over columns that carry the features' names."""
    tests = [F.col(c.feature) >= c.threshold if c.at_least else F.col(c.feature) < c.threshold for c in rule.conditions]
    return reduce(lambda a, b: a & b, tests)


def _grow(rows: DataFrame, names, cuts, bin_of, how: Learning) -> Rule | None:
    conditions: list[Condition] = []
    while len(conditions) < how.most_conditions:
        seen = rows.where(_on(Rule(tuple(conditions)))) if conditions else rows
        cells = F.array(*[F.struct(F.lit(n).alias("feature"), bin_of(n).alias("bin")) for n in names])
        counts = (
            seen.select("bad", F.explode(cells).alias("c"))
            .groupBy("c.feature", "c.bin")
            .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
            .collect()
        )
        table = {n: {} for n in names}
        for r in counts:
            table[r["feature"]][r["bin"]] = (r["p"], r["n"])
        p0 = sum(p for p, _ in table[names[0]].values())
        n0 = sum(n for _, n in table[names[0]].values())
        if not p0 or not n0:
            break
        best = None
        for name in names:
            below_p = below_n = 0
            for i, t in enumerate(cuts[name]):
                p, n = table[name].get(i, (0, 0))
                below_p, below_n = below_p + p, below_n + n
                for at_least, cp, cn in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                    if cp < how.cover:
                        continue
                    gain = cp * (math.log2(cp / (cp + cn)) - math.log2(p0 / (p0 + n0)))
                    # Ties go to the first statistic and threshold.
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, Condition(name, at_least, float(t)), cn)
        if best is None:
            break
        conditions.append(best[1])
        if best[2] == 0:
            break
    return Rule(tuple(conditions)) if conditions else None


def _prune(rows: DataFrame, rule: Rule, how: Learning) -> Rule | None:
    """The rule's best beginning on the pruning rows; none if it is not precise enough."""
    starts = [Rule(rule.conditions[: i + 1]) for i in range(len(rule.conditions))]
    sums = []
    for i, r in enumerate(starts):
        sums += [
            F.sum(F.when(_on(r), F.col("bad")).otherwise(0)).alias(f"p{i}"),
            F.sum(F.when(_on(r), 1 - F.col("bad")).otherwise(0)).alias(f"n{i}"),
        ]
    got = rows.agg(*sums).collect()[0]
    scored = []
    for i, r in enumerate(starts):
        p, n = got[f"p{i}"] or 0, got[f"n{i}"] or 0
        if p + n and p >= how.cover and p / (p + n) >= how.precision:
            scored.append(((p - n) / (p + n), p, -i, r))
    return max(scored, key=lambda x: x[:3])[-1] if scored else None


def decided(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    carry: tuple[str, ...] = (),
) -> tuple[DataFrame, list[Rule]]:
    """(rows with id, ``carry`` columns, statistics, ``base_failed`` and ``kept``; the rules learnt)."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["n_lines", "n_distinct", "n_upper", "n_digits"]
    statistics = with_statistics(df.select(id_col, text_col, *carry), text_col).select(id_col, *carry, *counts, *more)
    statistics = materialised(statistics, "quality-statistics")
    rules = learn(statistics, labels, id_col, label_col)
    out = statistics.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules

