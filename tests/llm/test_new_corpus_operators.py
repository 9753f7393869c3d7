"""Chat examples, source divergence and embedding whitening against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward_rows, docs_table, lower
from pyspark.sql import functions as F

from panelcheck.llm import chat, divergence, whitening

TURNS = "conv_id bigint, turn bigint, role string, text string, place int, segment string, stop string, n int, part int, size int, _conv int, _last int"
BITS = ["</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<s>", "<<SYS>>", "\\", "\\<", "<\\s>", "<", "[", "/s>", "]", " ", "\n", "a", "é", "\U0001f600", "ROLE]", "$0", "\\\\"]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3, 4, 5, 6) for r in rows], TURNS)


def turn_rows():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(BITS) for _ in range(rng.randrange(n)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "assistant", text(4)]), text(30)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]
    rows += [(200, None, None, None), (200, 1, "assistant", None), (None, 0, "user", "nobody's"), (None, 1, "assistant", "mine")]
    rows += [(201, 0, "assistant", "twice")] * 2 + [(202, 0, "user", "no reply"), (203, 0, "assistant", "long " * 50_000)]
    return rows


def in_order(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}


def plain_chat(rows):
    out = {}
    for conv, turns in in_order(rows).items():
        said = [t for r, t in turns if r == "assistant"]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, said)), digest("".join(said)))
    return out


def test_chat_output_reads_back_as_the_conversations(spark):
    rows = turn_rows()
    random.Random(1).shuffle(rows)
    got = chat.read_back(chat.expand(chat.with_hostile(spark, conversations(spark, rows)))).collect()
    want = plain_chat([*rows, (-1, 0, "user", chat.HOSTILE), (-1, 1, "assistant", chat.HOSTILE)])
    assert {r["conv_id"]: tuple(r[1:5]) for r in got} == want
    assert len(got) == len(want)


def test_chat_examples_are_prefixes_with_one_reply_under_the_mask(spark):
    rows = turn_rows()
    stream = chat.expand(conversations(spark, rows)).cache()
    texts = {(r["conv_id"], r["place"]): r for r in chat.render(stream).collect()}
    spans = {(r["conv_id"], r["place"]): r for r in chat.examples(stream).collect()}
    assert texts.keys() == spans.keys()
    total = Counter()
    for conv, turns in in_order(rows).items():
        whole = texts[conv, len(turns) - 1]["text"]
        for place, (role, text) in enumerate(turns):
            if role != "assistant" and place + 1 < len(turns):
                assert (conv, place) not in texts
                continue
            r, s = texts[conv, place], spans[conv, place]
            assert whole.startswith(r["text"]) and len(r["text"]) == s["n_chars"]
            assert (r["loss_start"], r["loss_stop"]) == (s["loss_start"], s["loss_stop"])
            if role == "assistant":
                assert chat.unescaped(r["text"][r["loss_start"] : r["loss_stop"]]) == text
            else:
                assert r["loss_start"] is None
            total[conv] += s["n_chars"]
        # control strings stand only where the template puts them
        assert [len(re.findall(re.escape(c), whole)) for c in chat.CONTROL] == [len(turns), len(turns), len(turns), len(turns), 0, 0, 0, 0]
    back = {r["conv_id"]: r["formatted_chars"] for r in chat.read_back(stream).collect()}
    assert back == dict(total)


def test_a_conversation_over_many_tasks_and_an_empty_table(spark):
    rows = [(7, t, "assistant" if t % 3 else "user", f"{t} " * 50) for t in range(4000)]
    stream = chat.expand(conversations(spark, rows).repartition(16))
    assert {r["place"] for r in stream.select("place").collect()} == set(range(4000))
    (got,) = chat.read_back(stream).collect()
    assert tuple(got[1:5]) == plain_chat(rows)[7]
    assert chat.read_back(chat.expand(conversations(spark, []))).collect() == []


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows):
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for _, text, lang, source in rows]
    found, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        found[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in found[lang].items() if n >= 3]
        own = {s: counts[g, s] for g, s in counts if g == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)

        def p(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        ps, q = {s: p(c) for s, c in own.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, f(ps[s][t], q[t])) for t in kept if own[s][t] and ps[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def text_rows(n, sources, rng):
    pool = ["the", "Of", "zürich", "Zürich", "internationalisation", "internationalism", "international", "ab", "abc", "abcdefgh", "abcdefghi", "abcdefgh" * 2, "日本語", "x1y2", "don't", "Kſ"]
    pool += ["w" * k for k in range(1, 40)] + [f"{chr(97 + a)}{chr(97 + b)}" for a in range(9) for b in range(9)]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(pool, k=rng.randrange(60))), rng.choice(["en", "de"]), f"s{int(rng.random() ** 2 * sources)}") for i in range(n)]


def as_rows(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_divergence_against_plain_counts(spark):
    rows = text_rows(400, 6, random.Random(5)) + awkward_rows() + [(900 + i, None, "xx", f"n{i}") for i in range(3)]
    assert as_rows(divergence.source_divergence(docs_table(spark, rows))) == plain_divergence(rows)


def test_divergence_over_several_blocks_of_sources_and_slices_of_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "TERMS", 20)
    rows = text_rows(300, 10, random.Random(6))
    assert as_rows(divergence.source_divergence(docs_table(spark, rows))) == plain_divergence(rows)


def test_divergence_takes_long_texts_in_pieces_as_one_document(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 300)
    rows = text_rows(30, 3, random.Random(7)) + [(99, " ".join(f"word{chr(97 + i % 20)}" for i in range(2000)), "en", "s0"), (98, "q" * 5000, "en", "s1")]
    columns = [pa.array([r[i] for r in rows], pa.string()) for i in (2, 3, 1)]
    got = defaultdict(lambda: [0, 0])
    for batch in divergence.shard_counts(iter([pa.record_batch(columns, names=["lang", "source", "text"])])):
        for r in batch.to_pylist():
            got[r["lang"], r["source"], r["term"]][0] += r["n"]
            got[r["lang"], r["source"], r["term"]][1] += r["docs"]
    want = defaultdict(lambda: [0, 0])
    for _, text, lang, source in rows:
        for t, n in Counter(TERM.findall(lower(text))).items():
            want[lang, source, t][0] += n
            want[lang, source, t][1] += 1
    assert dict(got) == dict(want)


def test_pointer_sort_orders_and_groups_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SMALL", 40)
    rng = random.Random(8)
    terms = ["a" * rng.randrange(1, 30) + rng.choice(["", "b", "é", "zz"]) for _ in range(3000)]
    raw = " ".join(terms).encode()
    p = divergence.Pointers(divergence._FOLD[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]))
    order, run = p.sorted_runs()
    assert [p.term(i).decode() for i in order] == sorted(terms, key=str.encode)
    assert run[-1] + 1 == len(set(terms)) and (np.diff(run) >= 0).all()


def test_divergence_of_an_empty_table(spark):
    assert divergence.source_divergence(docs_table(spark, [])).collect() == []


EMB = "vec_id bigint, embedding array<float>, label int, x int, key int, n int, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4) for i, v in rows], EMB)


def embedded(n, d, seed=0):
    rng = np.random.default_rng(seed)
    spread = rng.standard_normal((d, d)) * (0.9 ** np.arange(d))
    return (rng.standard_normal((n, d)) @ spread.T * 0.5 + rng.standard_normal(d)).astype(np.float32)


def check_whitening(got, kept):
    """``kept``: {vec_id: vector} of the remaining rows."""
    ids = sorted(kept)
    x = np.floor(np.array([kept[i] for i in ids], np.float64) * 64).astype(np.int64) + 1_000_000
    n = len(ids)
    spread = n * x - x.sum(axis=0)
    c = spread / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(32, x.shape[1])
    assert len(got) == n * k
    w = np.zeros((n, k))
    place = {i: a for a, i in enumerate(ids)}
    for r in got:
        a, b = place[r["vec_id"]], r["component"] - 1
        w[a, b] = r["whitened"]
        assert r["n"] == n and r["deviation"] == int((spread[a].astype(object) ** 2).sum())
        assert abs(r["explained"] - e[b] / np.trace(cov)) <= 1e-10 * r["explained"]
        assert r["identity_error"] <= 1e-10 and r["residual"] <= 1e-12
    want = c @ (u[:, :k] / np.sqrt(e[:k]))
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w * sign - want).max() < 1e-7


@pytest.mark.parametrize("d", [5, 64, 150])
def test_whitening_against_dense_eigenvectors(spark, d):
    x = embedded(1200, d)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(9001, None), (9002, [None] + [0.0] * (d - 1)), (9003, [float("nan")] * d), (9004, [float("inf")] + [0.0] * (d - 1)), (9005, []), (9006, [1.0])]
    check_whitening(whitening.whiten(vectors(spark, rows + bad).repartition(5)).collect(), dict(rows))


def test_whitening_of_equal_rows_one_row_and_none(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [0.5, 0.25]) for i in range(9)], [(1, None)]):
        assert whitening.whiten(vectors(spark, rows)).collect() == []


def test_whitening_repeated_rows_null_ids_and_flat_dimensions(spark):
    rows = [(1, [0.0, 1.0, 5.0]), (1, [0.0, 1.0, 5.0]), (None, [1.0, 1.0, 5.0]), (2, [3.0, 1.0, 5.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert [r["component"] for r in got] == [1] * 4
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, round(abs(r["whitened"]), 9)) for r in got)[-1][0]
    assert all(abs(r["explained"] - 1) < 1e-12 for r in got)


@pytest.mark.parametrize(("d", "decay"), [(400, 0.98), (400, 1.0), (130, 0.999)])
def test_jacobi_davidson_over_several_outer_steps(d, decay):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = 50 * decay ** np.arange(d) if decay < 1 else np.linspace(100, 1, d)
    a = (q * e) @ q.T
    found = whitening.jacobi_davidson(lambda u: a @ u, d, 32)
    assert np.abs(found.values - e[:32]).max() < 1e-10 * e[0]
    assert (np.linalg.norm(a @ found.vectors - found.vectors * found.values, axis=0) <= 2e-13 * e[0]).all()
    assert np.abs(found.vectors.T @ found.vectors - np.eye(32)).max() < 1e-12


def test_large_whole_entries_stay_exact():
    fit = whitening.Fit(3, [3 * 10**18 + 6, 9])
    x = np.array([[10**18 + 2, 3], [10**18, 4]])
    assert whitening._spread(x, fit).tolist() == [[0, 0], [-6, 3]]


def test_registered_rows_cover_the_tables(spark, folder):
    from panelcheck.llm.queries import QUERIES

    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    got = QUERIES["op11_chat_examples"](spark, folder)
    assert got.agg(F.sum("n_turns")).first()[0] == turns.count() + 2
    vec = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    assert QUERIES["op13_embedding_whitening"](spark, folder).count() == vec * 32
