"""Operators that look at one text at a time, against plain versions of their contracts."""

import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from helpers import DOCS, awkward_rows, digest, docs_table, random_text, words

from panelcheck.llm import language, pii, quality, secrets, tokens


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


# Secrets


def plain_secrets(text):
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return found + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def test_secret_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    pieces = ["password", "PassWD", "api_key", "APIKEY", "ſecret", "toKen", "=", ": ", '"', " ", "AKIA", "ABCD1234", "0a1b2c3d", "deadbeef", "é", "\n", "x", "token"]
    for _ in range(3000):
        text = random_text(rng, pieces, rng.randrange(30))
        assert [s[:4] for s in secrets.base_spans(text)] == sorted(plain_secrets(text)), text


def test_secret_ownership(spark):
    live, copied = "Zx9Kq2Lm7Vb4Nc8Rt5Yw1", "Qa3Ws5Ed7Rf9Tg1Yh2Uj4"
    rows = [(i, f"see {copied} {'and ' + live if i == 1 else ''}", "en", f"s{i}") for i in range(5)] + [(9, "password=abcdefgh1", "en", "s0")]
    out = {r["doc_id"]: r for r in by_id(secrets.digest_rows(secrets.find_secrets(docs_table(spark, rows))))}
    assert out[1]["spans"] == "token:30:51" and (out[1]["n_live"], out[1]["n_example"]) == (1, 1)
    assert out[2]["spans"] == "" and out[2]["n_example"] == 1
    assert out[9]["spans"] == "assign:0:18" and out[9]["base_sha256"] == digest([(0, 0, "assign", 18)])


def test_values_in_many_repositories_are_examples(spark):
    live, copied = "Zx9Kq2Lm7Vb4Nc8Rt5Yw1", "Qa3Ws5Ed7Rf9Tg1Yh2Uj4"
    rows = [(i, f"see {copied}" + (f" and {live}" if i < secrets.EXAMPLE_REPOS - 1 else ""), "en", "ab"[i % 2]) for i in range(secrets.EXAMPLE_REPOS)]
    out = {r["doc_id"]: r for r in by_id(secrets.digest_rows(secrets.find_secrets(docs_table(spark, rows))))}
    assert (out[0]["spans"], out[0]["n_live"], out[0]["n_example"]) == ("token:30:51", 1, 1)
    assert (out[secrets.EXAMPLE_REPOS - 1]["spans"], out[secrets.EXAMPLE_REPOS - 1]["n_example"]) == ("", 1)


def test_randomness_is_judged_over_the_whole_token():
    rng = random.Random(6)
    mixed = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(300))
    assert [s[2] for s in secrets.random_spans("A" * 256 + mixed, [])] == ["token"]
    assert secrets.random_spans(mixed[:256] + "A" * 3000, []) == []


# Personal data


def plain_pii(text):
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(d))]
        if 12 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0:
            found.append((m.start(), 2, "card", m.end()))
    return found + [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_personal_spans_equal_the_plain_patterns():
    rng = random.Random(2)
    pieces = ["a.b", "@", "mail", ".", "com", "1", "255", "300", "4539148803436467", "-", " ", "+", "(2", ")", "é", "%", "\n", "12.3", "0000", "_"]
    for _ in range(4000):
        text = random_text(rng, pieces, rng.randrange(25))
        assert pii.base_spans(text) == sorted(plain_pii(text)), text


def test_long_runs_take_linear_time():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "a.b@c." * 50_000):
        pii.candidates(run)
        secrets.scan_text(run)


def test_redaction_and_weak_supervision(spark):
    rows = [(i, f"mail ann.lee{i}@mail.com or call (415) 555-{1000 + i} now", "en", "a") for i in range(60)] + [(100, "score 12-345-6789 lot", "en", "b")]
    table = docs_table(spark, rows)
    found = {r["doc_id"]: r for r in by_id(pii.find_pii(table))}
    assert found[3]["n_email"] == 1 and found[3]["spans"].startswith("email:5:")
    clean = {r["doc_id"]: r["text"] for r in by_id(pii.redact(table))}
    assert "@" not in clean[3] and "<EMAIL>" in clean[3]
    assert pii.redact(table).columns == table.columns


def test_reliabilities_find_the_good_labelers():
    rng = random.Random(3)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        vote = tuple((1 if truth == (rng.random() < p) else -1) for p in (0.95, 0.9, 0.85, 0.55))
        counts[vote] = counts.get(vote, 0) + 1
    patterns = [(0, False, v, 1, n) for v, n in sorted(counts.items())]
    rate, post = pii.reliabilities(patterns)
    assert rate[1, 0, 2] > 0.9 > 0.7 > rate[1, 3, 2]
    weights = pii.train_classifier(patterns, post)
    assert pii.accepted((0, 0, "email", 1, False, [1, 1, 1, 1], 1), list(weights)) and not pii.accepted((0, 0, "email", 1, False, [-1, -1, -1, -1], 1), list(weights))


# Quality


def plain_quality(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    n_dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), n_dup, len(hit), failed


def test_quality_counts_equal_plain_counts():
    rng = random.Random(4)
    for _ in range(600):
        text = random_text(rng, ["a", "b ", "c\n", " ", "é ", "\x1c", "\x85", "#", "d e f ", "|"], rng.randrange(120))
        assert quality.judge(text)[:6] == plain_quality(text), repr(text)


def test_lines_are_judged_first():
    good = [", ".join(f"w{k}x{i}" for i in range(30)) + "." for k in range(4)]
    out = quality.judge("\n".join([*good[:3], "HOME | NEWS | SPORT | LOGIN", "CLICK HERE TO BUY NOW", good[0], good[3]]))
    assert out[6] and out[8] == "\n".join(good)
    assert not quality.judge("\n".join([good[0]] + [f"A{i} | B{i} | C{i} | D{i} | E{i} | F{i}" for i in range(30)]))[6]


# Tokens


def plain_count(word, scores):
    marked = tokens.MARK + word
    best = [(0, 0)]
    for end in range(1, len(marked) + 1):
        size = len(marked[end - 1].encode())
        options = [(best[end - 1][0] + tokens.BYTE_SCORE * size, best[end - 1][1] - size)]
        options += [(best[s][0] + scores[marked[s:end]], best[s][1] - 1) for s in range(end) if marked[s:end] in scores]
        best.append(max(options))
    return -best[-1][1]


def test_trie_counts_equal_a_plain_split(monkeypatch):
    scores = tokens.piece_scores()
    rng = random.Random(5)
    trie = tokens.Trie(scores)
    monkeypatch.setattr(tokens, "MAX_NODES", 300)
    for _ in range(400):
        word = random_text(rng, ["the", "ing", "é", "a", "re", "tion", "\U0001f600", "x", "q"], rng.randrange(1, 9))
        assert trie.count(word) == plain_count(word, scores) == trie.count(word)
    long = "tionq" * 200
    assert trie.count(long) == plain_count(long, scores)


# Language


def plain_language(rows, dim, seed):
    """{doc_id: (language, score)} with a vector made for every single trigram."""
    letters = {}

    def letter(c):
        if c not in letters:
            letters[c] = np.random.default_rng([seed, ord(c)]).integers(0, 2, dim, dtype=np.int8).astype(int) * 2 - 1
        return letters[c]

    def bundle(text):
        t = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
        held = {}
        for k in range(len(t) - 2):
            held[t[k : k + 3]] = held.get(t[k : k + 3], 0) + 1
        return sum((round(16 * math.log2(1 + n)) * np.roll(letter(x), 2) * np.roll(letter(y), 1) * letter(z) for (x, y, z), n in held.items()), np.zeros(dim, int))

    protos = {}
    for i, text, lang, _ in rows:
        if text and lang and zlib.crc32(str(i).encode()) % 4 != 2:
            protos[lang] = protos.get(lang, 0) + bundle(text)
    out = {}
    for i, text, *_ in rows:
        v = bundle(text or "")
        near = {name: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for name, p in protos.items()} if v.any() else {}
        best = max(sorted(near), key=near.get) if near else "und"
        out[i] = (best, min(1.0, max(0.0, near.get(best, 0.0))))
    return out


def test_language_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(language, "SLICE", 64)
    rng = random.Random(31)
    pools = {"en": "the and with house river morning".split(), "de": "der und mit haus fluß morgen".split(), "zh": [chr(0x4E00 + k) for k in range(900)], "ru": "и в не на я быть он".split()}
    rows = [(i, ("" if la == "zh" else " ").join(rng.choices(pools[la], k=rng.randrange(1, 60))) + rng.choice(["", " 12!", "\n"]), la, "a") for i in range(200) for la in [rng.choice([*pools])]]
    rows += [(300, "aaaa " * 5000, "en", "a"), (301, "", "en", "a"), (302, None, "en", "a"), (303, "12 34", "de", "a"), (304, "Haus", None, "a"), (305, "".join(rng.choices(pools["zh"], k=3000)), "zh", "b")]
    want = plain_language(rows, language.DIM, language.SEED)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs_table(spark, rows)).collect()}
    assert got.keys() == want.keys()
    for i, (lang, score) in want.items():
        assert got[i][0] == lang and abs(got[i][1] - score) < 2e-6, (i, got[i], want[i])


def test_language_of_a_text_with_very_many_trigrams():
    text = "".join(chr(c) for c in np.random.default_rng(3).integers(0x4E00, 0x9F00, 60_000))
    space, began = language.Space(language.DIM, language.SEED), time.monotonic()
    space.bundles([text], np.zeros(1, int))
    assert time.monotonic() - began < 20 and len(space.letters) <= language.LETTERS


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out) > 100
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_of_awkward_texts(spark):
    rows = awkward_rows() + [(20 + i, "the cat and the dog", "en", "a") for i in range(8)] + [(40 + i, "der hund und die katze", "de", "a") for i in range(8)] + [(60, "12 34 !!", "en", "a")]
    out = {r["doc_id"]: r for r in by_id(language.identify(docs_table(spark, rows)))}
    assert (out[1]["lang_pred"], out[1]["score"]) == ("und", 0.0) and out[60]["lang_pred"] == out[2]["lang_pred"] == "und"
    assert out[20]["lang_pred"] == "en" and out[40]["lang_pred"] == "de"
    assert len(by_id(language.identify(docs_table(spark, rows)))) == len(rows)
    kept = language.in_a_language(docs_table(spark, rows))
    assert kept.columns == docs_table(spark, rows).columns and {1, 2, 3, 60} & {r["doc_id"] for r in kept.collect()} == set()


# All of them


OPERATORS = [
    lambda d: secrets.digest_rows(secrets.find_secrets(d)), pii.find_pii, quality.clean_lines, tokens.count_tokens, language.identify, pii.redact,
]


@pytest.mark.parametrize("operator", OPERATORS)
def test_awkward_rows_keep_a_row_each(spark, operator):
    out = operator(docs_table(spark, awkward_rows())).collect()
    assert sorted(r["doc_id"] or 0 for r in out) == sorted(i or 0 for i, *_ in awkward_rows())


@pytest.mark.parametrize("operator", OPERATORS)
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], DOCS)).collect() == []
