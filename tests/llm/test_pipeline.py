"""The pipeline against a plain version of each of its stages."""

import hashlib
import math
import random

from helpers import item_hits, jaccard_classes

import corpus_pipeline
from panelcheck.llm import mixing


def corpus():
    rng = random.Random(21)
    english, german = ["the", "and", "with", "house", "river", "morning", "walked", "under", "thing", "these"], ["der", "und", "mit", "haus", "fluss", "morgen", "ging", "unter", "sache", "diese"]
    item = " ".join(f"probe{i}" for i in range(14))
    rows = []
    for i in range(240):
        pool = english if i % 2 else german
        w = [rng.choice(pool) + rng.choice(["", "", "s", "er", str(rng.randrange(99))]) for _ in range(rng.randrange(12, 90))]
        if i % 12 == 0:
            w[5:5] = item.split()[rng.randrange(5) :]
        if i % 7 == 0:
            w.insert(3, f"ann{i}@mail.example.com")
        rows.append((i, " ".join(w), "en" if i % 2 else "de", rng.choice("aaaaabbc"), None))
    for i in range(240, 300):
        w = rows[i - 240][1].split()
        if i % 3:
            w[-1] = "changed"
        rows.append((i, " ".join(w), "en", "a", None))
    for i in range(300, 330):
        w = rows[i - 300][1].split()
        rows.append((i, " ".join(w + [f"more{i}x{k}" for k in range(int(0.22 * (len(w) - 4)))]), "en", "a", None))
    rows += [(400, None, None, None, None), (401, "12 34", "en", "b", None), (402, "", "en", "b", None), (rows[5][0], *rows[5][1:])]
    return rows, [(1, item), (2, None)]


def plain_mix(docs):
    """(doc_id, epoch) of (doc_id, source, words)."""
    hash60 = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    size = {}
    for _, s, n in docs:
        size[s] = size.get(s, 0) + n
    size = {s: n for s, n in sorted(size.items()) if n}
    total = sum(size.values())
    p = [n / total for n in size.values()]
    weights = lambda a: [x**a / sum(y**a for y in p) for x in p]
    entropy = lambda w: -sum(x * math.log(x) for x in w)

    def bisect(lo, hi, holds):
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid) else (lo, mid)
        return lo

    wanted = entropy(p) + 0.5 * (math.log(len(p)) - entropy(p))
    often = lambda a: max(w / x for w, x in zip(weights(a), p, strict=True)) > 4
    alpha = bisect(0, 1, lambda a: entropy(weights(a)) >= wanted)
    alpha = round(bisect(alpha, 1, often) if often(alpha) else alpha, 6)
    out = []
    for (s, n), w in zip(size.items(), weights(alpha), strict=True):
        passes, rest = divmod(math.floor(w * total), n)
        mask, used = hash60(f"mix-1:pass:{passes}"), 0
        for _, d, k in sorted((hash60(f"mix-1:{d}") ^ mask, d, k) for d, t, k in docs if t == s):
            used += k
            out += [(d, e) for e in range(passes + (used <= rest))]
    return sorted(out)


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows, items = corpus()
    rows = [(i, t, la, s, None if t is None else len(t)) for i, t, la, s, _ in rows]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == documents.columns
        seen.append({(r["doc_id"], r["text"]) for r in docs.collect()})

    lettered = {(i, t) for i, t, *_ in rows if t and any(map(str.isalpha, t))}
    assert seen[0] == lettered
    first = {c for _, _, c in jaccard_classes(sorted(lettered), 5, 80)}
    assert len(first) < len({c for _, _, c in jaccard_classes(sorted(lettered))})  # pairs between 0.80 and 0.85
    alone = {(i, t) for i, t in lettered if i in first}
    assert seen[1] == alone and len(alone) < len(lettered) - 40
    clean = {(i, t) for i, t in alone if not item_hits(t, items)[1]}
    assert seen[2] == clean and len(clean) < len(alone) - 10
    masked = {(i, " ".join("<EMAIL>" if "@" in w else w for w in t.split(" "))) for i, t in clean}
    assert seen[3] == masked and any("<EMAIL>" in t for _, t in masked)

    source = {i: s for i, _, _, s, _ in rows}
    want = plain_mix([(i, source[i], len(t.split())) for i, t in sorted(masked)])
    got = sorted((r["doc_id"], r["epoch"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and mixing.MAX_REPEATS == 4.0


def test_stages_take_empty_tables_and_extra_columns(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string, _key int, body string, node int"
    rows = [(i, "the cat and the dog went home " + "x" * i, "en", "a", 9, 0.5, "k", 1, "b", 2) for i in range(6)] + [(None, None, None, None, None, None, None, None, None, None)]
    for some in ([], rows):
        docs = spark.createDataFrame(some, extra)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [c.split()[0] for c in extra.split(", ")]
        assert len(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) == (6 if some else 0)
