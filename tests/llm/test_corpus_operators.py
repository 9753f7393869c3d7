"""Operators that compare documents, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import DOCS, awkward_rows, docs_table, item_hits, jaccard_classes, shingle_set

from panelcheck.llm import decontaminate, html, jaccard, licenses, mixing

ITEMS = "item_id bigint, text string, key int, body string"


# Jaccard


def family_rows(seed=7, groups=25, size=6):
    """Near copies at many distances, copies, and texts that share a long passage."""
    rng = random.Random(seed)
    word = lambda: f"t{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    rows, i = [], 0
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 9, 15, 40, 120, 400]))] + (passage if g % 3 == 0 else [])
        for k in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(w) // 40, len(w) // 25])):
                w[rng.randrange(len(w))] = word()
            if k == 5:
                w = w[: max(1, len(w) - rng.randrange(1, 2 + len(w) // 8))]
            rows.append((i, " ".join(w).title() if k == 3 else " ".join(w), "en", "a"))
            i += 1
    return rows


def test_components_equal_brute_force(spark):
    rows = family_rows() + [(i if i is None else i + 1000, t, la, s) for i, t, la, s in awkward_rows() if i is not None]
    want = sorted(jaccard_classes([(i, t) for i, t, *_ in rows]))
    got = sorted(tuple(r) for r in jaccard.jaccard_components(docs_table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 30


def test_small_leaves_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 3)
    rng = random.Random(8)
    base = [f"t{rng.randrange(4000)}" for _ in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = f"u{rng.randrange(4000)}"
        rows.append((i, " ".join(w), "en", "a"))
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs_table(spark, rows)).collect())
    assert got == sorted((d, c) for d, _, c in jaccard_classes([(i, t) for i, t, *_ in rows]))


def test_every_linked_pair_shares_a_cell_and_passes_the_bound():
    rng = np.random.default_rng(9)
    for n in [6, 7, 8, 12, 13, 20, 33, 60, 150, 500, 2000]:
        for _ in range(150):
            b = n + int(rng.integers(0, max(1, (20 * n) // 17 - n + 1)))
            most = n + b
            need = int(jaccard.needed_overlap(np.int64(most)))
            if need > n:
                continue
            pool = rng.integers(0, 2**63, most, dtype=np.uint64)
            left, right = np.unique(pool[:n]), np.unique(np.concatenate((pool[:need], pool[n : n + b - need])))
            assert jaccard.overlap(left, right) >= need and 100 * need >= 85 * (most - need)
            assert set(jaccard.cell_keys(left).tolist()) & set(jaccard.cell_keys(right).tolist()), (n, b)
            assert np.minimum(jaccard.group_counts(left), jaccard.group_counts(right)).sum() >= need


def test_every_linked_pair_of_another_rule_shares_a_cell():
    rule, rng = jaccard.NEAR, np.random.default_rng(19)
    assert rule.smallest == 4 and jaccard.CONTRACT.smallest == 6
    for n in [4, 5, 6, 9, 14, 31, 80, 400]:
        for _ in range(100):
            b = n + int(rng.integers(0, n // 4 + 1))
            need = int(jaccard.needed_overlap(np.int64(n + b), rule))
            if need > n:
                continue
            pool = rng.integers(0, 2**63, n + b, dtype=np.uint64)
            left, right = np.unique(pool[:n]), np.unique(np.concatenate((pool[:need], pool[n : n + b - need])))
            assert 100 * need >= 80 * (n + b - need)
            assert set(jaccard.cell_keys(left, rule).tolist()) & set(jaccard.cell_keys(right, rule).tolist()), (n, b)


def test_cells_connect_whatever_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 40)
    docs = docs_table(spark, family_rows()).select("doc_id", F.col("text").alias("body")).repartition(5)
    by_cell = {}
    for t in {r["body"] for r in docs.collect()}:
        h = jaccard.shingles(t)
        for c in jaccard.cell_keys(h).tolist():
            by_cell.setdefault(c, set()).add(jaccard.node_of(h))
    label = {n: n for c in by_cell.values() for n in c}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    def joined(pairs):
        label.update({n: n for n in label})
        for a, b in pairs:
            label[root(a)] = root(b)
        return {frozenset(x for x in label if root(x) == r) for r in {root(n) for n in label}}

    want = joined((min(c), n) for c in by_cell.values() for n in c)
    assert joined((r["a"], r["b"]) for r in jaccard.cell_stars(jaccard.cells(docs)).collect()) == want
    assert max(map(len, want)) > 2


def test_bound_holds_for_very_large_sets():
    h = np.unique(np.random.default_rng(15).integers(0, 2**63, 70_000 * jaccard.GROUPS, dtype=np.uint64))
    counts = jaccard.group_counts(h)
    assert counts.max() > 65_535 and counts.sum(dtype=np.int64) == len(h) >= jaccard.needed_overlap(np.int64(2 * len(h)))


def test_shingle_hashes_name_the_same_sets():
    rng = random.Random(10)
    seen = {}
    for _ in range(2000):
        text = "".join(rng.choice(["a", "B", "b ", " ", "\n", "é", "É ", "c\t", "d "]) for _ in range(rng.randrange(14)))
        h, s = jaccard.shingles(text), shingle_set(text)
        assert len(h) == len(s) and seen.setdefault(s, h.tobytes()) == h.tobytes(), repr(text)
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("rule", [jaccard.CONTRACT, jaccard.NEAR])
def test_one_of_each_group(spark, rule):
    rows = family_rows() + awkward_rows()
    table = docs_table(spark, [(None if i is None else i + 5000 * (k >= 150), t, la, s) for k, (i, t, la, s) in enumerate(rows)])
    kept = jaccard.one_of_each_group(table, rule=rule)
    got = [r["doc_id"] for r in kept.collect()]
    first = {c for _, _, c in jaccard_classes([(r["doc_id"], r["text"]) for r in table.collect()], rule.words, rule.num)}
    assert kept.columns == table.columns and set(got) == first and len(got) == len(set(got))


# Benchmark


def bench_rows():
    rng = random.Random(11)
    word = lambda: rng.choice(["The", "of", "and", f"k{rng.randrange(60)}", f"K{rng.randrange(900)}", "é"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 4, 9, 10, 11, 25])))) for i in range(30)] + [(50, None), (51, "..."), (52, "of of of of of of of of of of of of"), (29, "k1 k2 k3")]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            v = rng.choice(items[:30])[1].split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = v if i % 2 else v[:12]
        docs.append((i, ", ".join(w).upper() if i % 5 == 0 else " ".join(w), "en", "a"))
    docs += [(200, "of " * 40, "en", "a"), (201, None, "en", "a"), (202, "", None, None), (203, "k1 k2 k3", "en", "a"), (203, "k1 k2 k3", "en", "a"), (None, "k1 k2 k3", "en", "a")]
    return docs, items


def test_hits_equal_brute_force(spark):
    docs, items = bench_rows()
    bench = spark.createDataFrame([(i, t, 1, "b") for i, t in items], ITEMS)
    out = decontaminate.decontaminate(docs_table(spark, docs), bench).collect()
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out)
    import hashlib

    want = []
    for i, t, *_ in docs:
        n, hit, ids = item_hits(t, items)
        want.append((-1 if i is None else i, n, hit, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), hit > 0))
    assert got == sorted(want) and sum(w[5] for w in want) > 30
    kept = decontaminate.clean_documents(docs_table(spark, docs), bench)
    assert kept.columns == docs_table(spark, docs).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if not w[5])


def test_proximity_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    near = "alpha beta gamma delta x epsilon zeta eta theta iota kappa"
    docs = [(1, item, "en", "a"), (2, near, "en", "a"), (3, "kappa far from alpha", "en", "a")] + [(10 + i, item.replace(w, ""), "en", "a") for i, w in enumerate(item.split()[1:9])]
    bench = spark.createDataFrame([(1, item, 1, "b")], ITEMS)
    out = {r["doc_id"]: r for r in decontaminate.decontaminate(docs_table(spark, docs), bench, rarest=9).collect()}
    assert out[1]["contaminated"] and not out[2]["contaminated"]
    assert (out[1]["n_near_items"], out[2]["n_near_items"], out[3]["n_near_items"]) == (0, 1, 0)


def plain_near(text, item, slop, size=10):
    """Whether some window of the item has every word on slop + 1 diagonals in a row, but is whole on none of them."""
    w, v = text.lower().split(), item.lower().split()
    n = min(size, len(v))
    for s in range(len(v) - n + 1):
        for low in range(-len(v), len(w)):
            put = lambda k, d: 0 <= d + k < len(w) and w[d + k] == v[k]
            near = range(low, low + slop + 1)
            if all(any(put(k, d) for d in near) for k in range(s, s + n)) and not any(all(put(k, d) for k in range(s, s + n)) for d in near):
                return True
    return False


def test_registered_proximity_equals_brute_force(spark, tmp_path):
    from panelcheck.llm.queries import QUERIES

    rng = random.Random(14)
    items = [(i, " ".join(f"q{i}x{rng.randrange(30)}" for _ in range(n))) for i, n in enumerate([12, 10, 6, 15, 2])]
    docs = []
    for i, text in items[:4]:
        w = text.split()
        for gap in range(decontaminate.SLOP + 3):
            for at in range(1, len(w), 2):
                docs.append(" ".join(["pre"] * (len(docs) % 9) + w[:at] + ["x"] * gap + w[at:]))
        docs += [" ".join(w[:4] + ["lost"] + w[5:]), " ".join([w[1], w[0], *w[2:]]), " ".join([w[0], w[-1]]), " ".join(w[2:])]
        docs += [" ".join(w[rng.randrange(len(w))] for _ in range(40)) for _ in range(8)]
    rows = [(i, t, "en", "a") for i, t in enumerate(docs)]
    docs_table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t, 1, "b") for i, t in items], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = QUERIES["op4_decontaminate"](spark, str(tmp_path))
    rows = out.collect()
    got = {r["doc_id"]: r["n_near_items"] for r in rows}
    want = {i: sum(plain_near(t, item, decontaminate.SLOP) for _, item in items) for i, t in enumerate(docs)}
    assert got == want and sum(want.values()) > 60

    import duckdb

    from panelcheck.llm.queries import ORACLES

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = con.execute(ORACLES["op4_decontaminate"]).df()
    assert sorted(found.columns) == sorted(out.columns)
    assert sorted(tuple(r[c] for c in out.columns) for r in rows) == sorted(found[out.columns].itertuples(index=False, name=None))


def test_long_item_and_repeated_passage(spark):
    """A passage that one document repeats 20,000 times, an item of 5,000 words, empty tables."""
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = " ".join(f"w{(i * i) % 7919}x{i % 13}" for i in range(5000))
    rows = [(1, " ".join([passage] * 20_000), "en", "a"), (2, "intro " + long, "en", "a"), (3, long[:-1], "en", "a"), (4, None, None, None)]
    bench = spark.createDataFrame([(1, passage, 1, "b"), (2, long, 1, "b")], ITEMS)
    out = {r["doc_id"]: r for r in decontaminate.decontaminate(docs_table(spark, rows), bench).drop("spans").collect()}
    assert [out[i]["n_hit"] for i in (1, 2, 3, 4)] == [200_000, 5000, 4999, 0]
    assert [out[i]["n_items"] for i in (1, 2, 3, 4)] == [1, 1, 1, 0]
    assert decontaminate.decontaminate(docs_table(spark, []), bench).collect() == []
    none = decontaminate.decontaminate(docs_table(spark, rows[3:]), spark.createDataFrame([], ITEMS)).collect()
    assert [(r["n_words"], r["n_hit"], r["n_near_items"], r["contaminated"]) for r in none] == [(0, 0, 0, False)]


# Pages


def test_lines_of_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <nav><a href="/">Home</a></nav><div class="cookie-notice">We use</div><aside>side</aside><article><header><h1>Head&nbsp;line</h1></header>
    <p>One &lt;two&gt;<b>bold</b><br>three\n four</p><aside>inner</aside><section id="comments"><p>me too</p></section></article>
    <article class="comment">no</article><form>f</form><footer>&copy;</footer></body></html>"""
    assert [t for t, p in html.lines_of(page) if p == html.IN_MAIN] == ["Head line", "One <two>bold", "three four"]
    assert html.lines_of(None) == [] and html.lines_of("a < b & c") == [("a < b & c", html.PLAIN)]


def test_longest_common_subsequence_has_the_right_length(monkeypatch):
    rng = random.Random(12)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        for bits in (html.DIRECT, 16):  # one table, and cut in two again and again
            monkeypatch.setattr(html, "DIRECT", bits)
            shared = html.common_lines(np.array(a, np.int64), np.array(b, np.int64))
            assert shared.sum() == best[-1][-1]
            rest = iter(b)
            assert all(x in rest for x, s in zip(a, shared, strict=True) if s)
        monkeypatch.undo()


def test_long_pages_are_aligned_in_time():
    import time

    rng = random.Random(21)
    a, b = (np.array([0 if rng.random() < 0.5 else s * (i + 1) for i in range(100_000)]) for s in (1, -1))
    began = time.time()
    assert html.common_lines(a, b).sum() == min((a == 0).sum(), (b == 0).sum())
    assert html.common_lines(np.zeros(100_000, np.int64), np.zeros(90_000, np.int64)).sum() == 90_000
    assert len(html.lines_of("<li>" * 50_000 + "</b>" * 50_000 + "<p><b>x" * 50_000)) == 50_000
    assert time.time() - began < 10


def test_end_tags_that_are_left_out():
    chrome = lambda page: [t for t, p in html.lines_of(page) if p == html.IN_CHROME]
    assert chrome('<p class="notice">Ad<p>Main text') == ["Ad"]
    assert chrome('<ul><li class="share">a<li>b<ul><li>c</ul><li class="ad">d</ul>e') == ["a", "d"]
    assert chrome('<table><tr><td class="sidebar">x<td>y<tr><th>z</table>') == ["x"]
    assert chrome('<dl><dt class="ad">x<dd>y<dt>z</dl><div class="sidebar"><p>u</div>v') == ["x", "u"]


def test_class_words_are_whole_and_reach_the_main_part_only_where_plain():
    main = lambda page: [t for t, p in html.lines_of(page) if p == html.IN_MAIN]
    for name in ("social-science", "search-algorithms", "legal-history", "related-works-cited"):
        assert main(f'<main class="{name}">t</main>') == main(f'<main><div id="{name}">t</div></main>') == ["t"]
    assert main('<main><div class="search">t</div><p>u</main>') == ["t", "u"]
    for name in ("comments", "ad-slot-3", "share-buttons", "related-list", "cookie-notice"):
        assert main(f'<main><div class="x {name}">t</div><p>u</main>') == ["u"]


def test_quotes_stay_until_most_pages_of_the_host_have_them(spark):
    def page(i):
        quote = "<p>A passage that fifty quote.</p>" if 100 <= i < 150 else ""
        return f"<body><main><h1>Story {i}</h1>{quote}<p>Only here {i}.</p><div>Read next</div></main></body>"

    rows = [(i, f"http://a.org/x/{i:03d}", page(i)) for i in range(300)]
    out = {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out == {i: f"Story {i}" + (" A passage that fifty quote." if 100 <= i < 150 else "") + f" Only here {i}." for i in range(300)}


def test_template_goes_without_named_parts(spark):
    page = lambda i: f"<body><div>Site name</div><div>Menu one</div><h1>Story {i}</h1><p>Only here {i}.</p><div>Contact us</div></body>"
    rows = [(i, f"http://a.org/x/{i:03d}", page(i), 1, "r") for i in range(300)] + [(900, None, None, 1, "r"), (901, "x", "", 1, "r"), (902, "http://b.org/", "lone", 1, "r")]
    rows += [(0, "http://a.org/x/000", page(0), 1, "r")]
    out = html.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, row int, lines string")).collect()
    texts = {r["page_id"]: (r["text"], r["n_chars"]) for r in out}
    assert len(out) == len(rows) and all(texts[i] == (t := f"Story {i} Only here {i}.", len(t)) for i in range(300))
    assert texts[900] == texts[901] == ("", 0) and texts[902] == ("lone", 4)
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html.extract_main_text(empty).collect() == []


def test_alignment_decides_inside_and_outside_the_main_part(spark):
    def page(i):
        quote = "<p>A passage that two quote.</p>" if i in (4, 5) else ""
        return f"<body><div>Site name</div><div>Dateline {i}</div><main><h1>Story {i}</h1><div>Send to a friend</div><p>Only here {i}.</p>{quote}<div>Read next</div></main><div>Contact us</div></body>"

    rows = [(i, f"http://a.org/x/{i:03d}", page(i)) for i in range(40)]
    out = {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out == {i: f"Dateline {i} Story {i} Only here {i}." + (" A passage that two quote." if i in (4, 5) else "") for i in range(40)}


def test_long_menus_are_no_copies_and_runs_of_copies_end(spark, monkeypatch):
    monkeypatch.setattr(html, "PIECE", 7)
    div = lambda lines: "".join(f"<div>{x}</div>" for x in lines)
    menu = [f"Menu {k}" for k in range(40)]
    own = lambda i: [f"Own {i} {k}" for k in range(8)]
    rows, want = [], {}
    for i in range(30):
        for v in range(30 if i == 12 else 10 if i == 20 else 5 if i in (0, 29) else 1):
            more = [f"Session {v}"] if i == 20 else []
            rows.append((len(rows), f"http://a.org/{i:02d}?v={v:02d}", div(menu + own(i) + more)))
            want[len(rows) - 1] = " ".join(own(i) + more)
    out = {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out == want


# Mixing


def test_mix_repeats_and_budget(spark):
    rng = random.Random(13)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 9))), "en", rng.choice("aaaaaaaabbbc")) for i in range(900)] + [(2000, None, "en", None), (2001, "", "en", "z"), (2002, "x y", "en", None), (2002, "x y", "en", None)]
    size = {}
    for _, t, _, s in rows:
        size[s or ""] = size.get(s or "", 0) + len((t or "").split())
    out = mixing.mix(docs_table(spark, rows)).collect()
    given, copies = {}, {}
    for r in out:
        given[r["source"]] = given.get(r["source"], 0) + r["n_tokens"]
        copies.setdefault(r["doc_id"], []).append(r["epoch"])
        assert 0 <= r["block"] < mixing.MIX_BLOCKS
    target = {r["source"]: r["source_target"] for r in out}
    assert all(target[s] - 16 <= given[s] <= target[s] for s in target) and "z" not in target
    assert all(target[s] <= mixing.MAX_REPEATS * size[s] + 1 for s in target) and target["c"] > size["c"]
    assert all(sorted(e) == sorted(sum(([k] * (2 if d == 2002 else 1) for k in range(max(e) + 1)), [])) for d, e in copies.items())
    assert mixing.mix(docs_table(spark, [])).collect() == []


# Licences


def test_license_families(spark):
    rows = [
        (1, "some code\nReleased under the MIT License.\nmore words in a line", "en", "a"),
        (2, "Licensed under the Apache License, Version 2.0 (the \"License\");", "en", "a"),
        (3, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "en", "a"),
        (4, "The license of the driver was taken by the police because of the terms of the law.", "en", "a"),
    ] + [(100 + i, f"plain text number {i} about the weather and the people of the town\nunder the bridge they met", "en", "a") for i in range(60)]
    rows += [(5000 + (i or 0), *rest) for i, *rest in awkward_rows()]
    out = [r.asDict() for r in licenses.scan_licenses(docs_table(spark, rows)).collect()]
    families = {r["doc_id"]: r["families"] for r in out}
    assert len(out) == len(rows)
    assert (families[1], families[2], families[3], families[100]) == ("mit", "apache-2.0", "gpl", "")
    assert families[4] == "" and sum(r["n_licensed"] for r in out if r["doc_id"] >= 100) == 0
    assert licenses.scan_licenses(docs_table(spark, [])).collect() == []


def test_repeated_lines_count_once_in_the_licence_sample(spark):
    long = "z " * 600 + "end"
    different = [f"ordinary line {i} of the town" for i in range(60)] + [long]
    docs = [(1, "\n".join(["the same boilerplate for this page"] * 5000)), (2, "\n".join(different))]
    sample = [tuple(r["w"]) for r in licenses.ordinary(spark.createDataFrame(docs, "key bigint, body string")).collect()]
    assert len(sample) == len(set(sample)) == 62 and tuple(long.split()) in sample
    assert licenses.ordinary(spark.createDataFrame([], "key bigint, body string")).collect() == []


@pytest.mark.parametrize("operator", [jaccard.jaccard_components, mixing.mix, jaccard.one_of_each_group])
def test_empty_and_extra_columns(spark, operator):
    assert operator(spark.createDataFrame([], DOCS)).collect() == []
