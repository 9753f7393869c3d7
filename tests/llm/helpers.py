"""Small tables with every awkward case, and plain versions of the contracts."""

from __future__ import annotations

import hashlib
import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, body string, `key` int, row int, node int, n int, count int, label string, block int, spans string"


def docs_table(spark, rows):
    """(doc_id, text, lang, source) as documents, with extra columns of clashing names."""
    full = [(i, t, lang, s, None if t is None else len(t), 1, "x", 2, 3, 4, 5, 6, "y", 7, "z") for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


def awkward_rows():
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one", None, "b"), (5, long, "en", "b"),
        (6, "same words here again and again\nsame words here again and again", "en", "c"), (7, "same words here again and again\nsame words here again and again", "en", "c"),
        (8, "twice", "en", "a"), (8, "twice", "en", "a"), (None, "no id here", "de", "a"), (9, "Kſ \U0001f600 12 ; password=ab", "fr", None),
    ]


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return [] if text is None else re.findall(r"[^\x20\x09-\x0D]+", text)


def random_text(rng: random.Random, pieces, n):
    return "".join(rng.choice(pieces) for _ in range(n))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)).encode()).hexdigest()


def shingle_set(text, size=4):
    w = words(lower(text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def jaccard_classes(rows, size=4, percent=85):
    """(doc_id, size, smallest reachable id) of (doc_id, text) by comparing all pairs."""
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = root(i)
        least[r] = min(x for x in (d, least.get(r)) if x is not None) if d is not None or least.get(r) is not None else None
    return [(d, len(s), least[root(i)] if s else d) for i, (d, s) in enumerate(sets)]


def item_hits(text, items, size=10):
    """(words, hit words, ids of items with a window in the text)."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(pattern, lower(text or ""))
    hit, ids = set(), set()
    for item, body in items:
        v = re.findall(pattern, lower(body or ""))
        n = min(size, len(v))
        for a in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[a : a + n]:
                    hit |= set(range(i, i + n))
                    ids.add(str(item))
    return len(w), len(hit), ids
