"""Plain versions of the operators, over Python values."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def near_groups(docs, size=5, percent=85):
    """doc_id to (set size, smallest linked id, kept), comparing all pairs that share a shingle."""
    sets = {}
    for i, t in docs:
        w = words(t)
        grams = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] * bool(w)
        sets[i] = frozenset(grams)
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        for j in set().union(*(holders[x] for x in s)) if s else ():
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def quality_counts(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    covered = {p for i, x in enumerate(windows) if seen[x] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def repeated_bytes(docs, span=100):
    """doc_id to (bytes, removed, runs, digest of the rest)."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - span + 1):
            k = b[p : p + span]
            if k in seen:
                mark[p : p + span] = b"\1" * span
            else:
                seen.add(k)
        kept = bytes(x for x, m in zip(b, mark) if not m)
        runs = sum(1 for q in range(len(b)) if mark[q] and (q == 0 or not mark[q - 1]))
        out[i] = (len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


def lm_scores(docs, order):
    """doc_id to (held out, tokens, known, training tokens, base, score), by recursion over contexts."""
    tokens = {i: [*words(t), "</s>"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    counts = [Counter() for _ in range(order + 1)]
    texts = 0
    for i in tokens:
        if held[i]:
            continue
        texts += 1
        x = ["<s>", *tokens[i]]
        for m in range(1, order + 1):
            for k in range(m == 1, len(x) - m + 1):
                counts[m][tuple(x[k : k + m])] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    back = [0, 0]
    for c in counts[2:]:
        back.append(min(max(sum(1 for k in c.values() if k == 1) / sum(c.values()), 0.01), 0.99) if c else 0.99)
    count = lambda g: texts if g == ("<s>",) else counts[len(g)][g]

    def p(g):
        if len(g) == 1:
            return (count(g) + 1) / (n + v + 1)
        c = count(g[:-1])
        return (1 - back[len(g)]) * count(g) / c + back[len(g)] * p(g[1:]) if c else p(g[1:])

    out = {}
    for i, t in tokens.items():
        x = ["<s>", *t]
        score = sum(math.log10(p(tuple(x[max(0, k - order + 1) : k + 1]))) for k in range(1, len(x)))
        base = sum(math.log10((count((w,)) + 1) / (n + v + 1)) for w in t)
        out[i] = (held[i], len(t), sum(count((w,)) > 0 for w in t), n, base, score)
    return out
