"""Leaves of the n-gram Jaccard join."""

import numpy as np

from panelcheck.llm import jaccard


def test_small_sets_move_less_often(spark):
    """A block of 900 small sets is one leaf (a node moves once); large sets keep leaves of LEAF nodes; names follow the order of sizes."""
    rows = [(1, k, 100 + k % 7, bytes(512), b"") for k in range(900)] + [(1, 1000 + k, 5000 + k, bytes(512), b"") for k in range(600)]
    packed = jaccard.leaves(spark.createDataFrame(rows, "block bigint, node bigint, n bigint, counts binary, hashes binary")).collect()
    small = {r["leaf"] for r in packed if r["n"] <= jaccard.SMALL_SET}
    assert len(packed) == 1500 and len(small) == 1
    large = [r["leaf"] for r in packed if r["n"] > jaccard.SMALL_SET]
    assert max(large.count(x) for x in set(large)) <= jaccard.LEAF
    leaf = [r["leaf"] for r in sorted(packed, key=lambda r: r["n"])]
    assert leaf == sorted(leaf)


def test_cells_of_a_node_are_sent_one_after_the_other(spark):
    texts = [(" ".join(f"w{k}x{i}" for i in range(60)),) for k in range(30)]
    rows = jaccard.cells(spark.createDataFrame(texts, "body string").coalesce(1)).filter("near is null").collect()
    node = np.array([r["node"] for r in rows])
    assert len(rows) > 300 and np.count_nonzero(node[1:] != node[:-1]) == 29


def test_sets_move_only_where_a_node_may_link(spark):
    """Of two leaves only the nodes with an open pair move with their sets; a pair inside a leaf counts once."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(1, 2**63, 300, dtype=np.uint64)) for _ in range(6)]
    sets.append(np.unique(np.concatenate((sets[0][5:], rng.integers(1, 2**63, 5, dtype=np.uint64)))))
    rows = [(1, k % 2, k, len(h), bytearray(jaccard.group_counts(h).tobytes()), bytearray(h.tobytes())) for k, h in enumerate(sets)]
    packed = spark.createDataFrame(rows, "block bigint, leaf bigint, node bigint, n bigint, counts binary, hashes binary")
    pairs = spark.createDataFrame([(1, 0, 10, 1), (1, 1, 11, 1), (1, 0, 12, 1), (1, 1, 12, 2)], "block bigint, leaf bigint, pair bigint, side int")
    met = sorted((r["pair"], r["node"]) for r in jaccard.met_nodes(packed, pairs).collect())
    assert met == [(10, 0), (10, 6)]
    assert [(r["a"], r["b"]) for r in jaccard.leaf_links(packed, pairs).collect()] == [(0, 6)]


def test_large_unrelated_sets_do_not_move(spark):
    """With 128 coordinates any two sets of some thousand shingles of a block pass for similar; with as many as they need only the near ones do."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(1, 2**63, n, dtype=np.uint64)) for n in (5000, 5100, 5200, 8000, 8300, 900, 1100)]
    sets.append(np.unique(np.concatenate((sets[0][400:], rng.integers(1, 2**63, 100, dtype=np.uint64)))))
    rows = [(1, 0, k, len(h), bytearray(jaccard.fine_counts(h).tobytes()), bytearray(h.tobytes())) for k, h in enumerate(sets)]
    packed = spark.createDataFrame(rows, "block bigint, leaf bigint, node bigint, n bigint, counts binary, hashes binary")
    pairs = jaccard.leaf_pairs(packed)
    assert sorted(r["node"] for r in jaccard.met_nodes(packed, pairs).collect()) == [0, 7]
    assert [(r["a"], r["b"]) for r in jaccard.leaf_links(packed, pairs).collect()] == [(0, 7)]


def test_bounds_meet_at_the_coarser_coordinates():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(1, 2**63, n, dtype=np.uint64)) for n in (1000, 1060, 4000)]
    sets.append(np.unique(np.concatenate((sets[0], rng.integers(1, 2**63, 90, dtype=np.uint64)))))
    bound = jaccard.Bounds([jaccard.fine_counts(h) for h in sets])
    assert bound.width.tolist() == [128, 256, 512, 256]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert bound(i, np.array([j]))[0] >= jaccard.overlap(a, b)
            assert bound(i, np.array([j]))[0] == np.minimum(*(jaccard.group_counts(h, int(bound.width[[i, j]].min())) for h in (a, b))).sum()


def test_sets_are_not_stored_and_an_id_may_have_two_texts(spark, monkeypatch):
    """Neither points nor leaves hold sets; rows of one id with different texts keep their own sets."""
    wrote = {}
    keep = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: wrote.setdefault(name, df) and keep(df, name))
    a, b = ([f"{c}{i}" for i in range(300)] for c in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-3], "x"])), (3, " ".join([*b[:-3], "y"])), (3, " ".join([*b[:-3], "y"])), (4, "alone")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 4)]
    assert "jaccard-points" in wrote and all("hashes" not in df.columns for df in wrote.values())
