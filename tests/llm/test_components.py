"""Components of edges by contraction."""

import itertools
import random

from panelcheck.llm import jaccard


def plain_components(edges):
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= (root[a], root[b]) != (low, low)
            root[a] = root[b] = low
    return root


def test_components_of_paths_stars_and_groups(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(0, 60)]
    mixed = [(n, n + 7 if n % 2 else n - 5) for n in range(200, 260)]
    star = [(500, n) for n in range(501, 540)] + [(539, 600), (600, 499)]
    loose = [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in path + mixed + star + loose if a != b]
    frame = lambda e: spark.createDataFrame(e, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in jaccard.components(frame(edges), "t").collect()}
    assert got == plain_components(edges)
    assert jaccard.components(frame([]), "t").collect() == []


def test_edges_of_one_group_do_not_grow_with_its_square(spark):
    group = list(itertools.combinations(range(60), 2))
    assert jaccard.starred(spark.createDataFrame(group, "a bigint, b bigint")).count() == 59
