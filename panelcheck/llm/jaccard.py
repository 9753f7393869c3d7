"""N-gram Jaccard join over count vectors.

A document is the set of its distinct shingles of some words.  Two documents link when their Jaccard similarity
reaches a threshold; a ``Rule`` states both (``CONTRACT``: 4 words and 0.85, ``NEAR``: 5 words and 0.8).
The operator gives every document the smallest id it can reach by links.

1. Equal sets become one node (a copy group of any size costs one row).
2. Shingles are hashed into groups.  A pair that links differs in at most r shingles, so of r + 1 + e groups at least 1 + e
   hold the same shingles in both.  Each node keeps its r + 1 fullest groups; a pair that links shares one of them,
   whichever e groups each side leaves out (prefix filter over groups, fullest first).
   Nodes that share a full group fall into one cell; cells chain into blocks.
   A task first joins the nodes it holds itself, so a cell of any size sends a row or two a task through the one exchange by cell.
   These cells are the upper levels of the index: with a hundred coordinates a tree over all points prunes nothing.
3. In a block, nodes are packed into leaves of an R-tree (sort by size and by coordinates, then runs).
   A leaf keeps the largest count of each coordinate; the overlap of two leaves or nodes is at most the sum of coordinate minima.
   Pairs of leaves, then of nodes, that cannot reach the overlap they need are skipped.
   First the counts of such leaves meet, large sets with more coordinates; then the sets of the nodes that have an open pair there.
   Sets are made from the texts where they are needed and never stored.
4. Surviving pairs are verified by their shingles, in the task that holds both leaves; only links that join two
   still unconnected nodes of that task leave it.
5. Links become components by contraction: minimum of neighbours with pointer jumping, then the edges between what is left.

Nothing is sampled or capped.  The two sides of a link are compared by 64-bit hashes of shingles.

Defined results: a null or blank text has an empty set and links with nothing; so do documents with fewer than one word;
repeated rows share id and class; a null id has component null unless its set equals another document's; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcheck.llm.common import fresh, in_order, written

GROUPS = 128  # coordinates of a point
LEAF = 256  # nodes of a leaf; four times as many where sets are small, as a node moves once for each leaf that its own may meet
SMALL_SET = 2048  # shingles
LOAD = 8  # shingles a fine coordinate; beyond some 15 two unrelated sets pass for similar by their counts
_MASK = (1 << 64) - 1


class Rule(NamedTuple):
    """Which documents link: shingles of so many words, and the least similarity num / den (below 1)."""

    words: int
    num: int
    den: int

    @property
    def smallest(self) -> int:
        """Smaller sets link with equal sets only."""
        return -(-self.num // (self.den - self.num))


CONTRACT = Rule(4, 85, 100)
NEAR = Rule(5, 80, 100)

_rng = np.random.default_rng(20240502)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**61)) * 8 + 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self, base: int) -> None:
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = np.uint64(pow(self.base, len(self.table), 1 << 64))
            self.table = np.concatenate((self.table, self.table * step))
        return self.table[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z in lower case."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)  # bytes.lower() changes A-Z only
    if not len(data):
        return np.empty(0, np.uint64)
    inside = np.concatenate(([False], ~_BLANK[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _UP.upto(len(data)), dtype=np.uint64)))
    return mix((total[end] - total[start]) * _DOWN.upto(len(data) + 1)[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, size: int = CONTRACT.words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    w = word_hashes(text or "")
    n = len(w)
    if n == 0:
        return w
    if n < size:
        key, count = np.uint64(n), 1
        parts = [w[k : k + 1] for k in range(n)]
    else:
        key, count = np.uint64(size), n - size + 1
        parts = [w[k : k + count] for k in range(size)]
    h = np.full(count, key, np.uint64)
    for part in parts:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + part)
    return np.unique(h)


def needed_overlap(both: np.ndarray, rule: Rule = CONTRACT) -> np.ndarray:
    """The least intersection of two linked sets whose sizes sum to ``both``."""
    return -(-rule.num * both // (rule.num + rule.den))


def _band_end(top: int, rule: Rule) -> int:
    """The end of the band that starts at size ``top``."""
    return rule.den * top // rule.num + 1


@lru_cache(maxsize=None)
def band_of_size(n: int, rule: Rule = CONTRACT) -> int:
    """Sizes are cut into bands so that linked sets lie in one band or two adjacent ones."""
    band, end = 0, _band_end(rule.smallest, rule)
    while n >= end:
        band, end = band + 1, _band_end(end, rule)
    return band


@lru_cache(maxsize=None)
def plan(band: int, rule: Rule = CONTRACT) -> tuple[int, int]:
    """(groups, groups kept) for pairs whose larger set lies in the band."""
    top = rule.smallest
    for _ in range(band + 1):
        top = _band_end(top, rule)
    largest = top - 1
    differ = max(s + int(needed_overlap(np.int64(s), rule)) * -2 for s in range(2 * largest - 40 if largest > 25 else 2, 2 * largest + 1))
    return differ + 1 + max(1, differ // 4), differ + 1


def cell_keys(h: np.ndarray, rule: Rule = CONTRACT) -> np.ndarray:
    """The cells of a node: for its own band and the next, its fullest groups by their contents."""
    if len(h) < rule.smallest:
        return np.empty(0, np.int64)
    out = []
    band = band_of_size(len(h), rule)
    for b in (band, band + 1):
        groups, kept = plan(b, rule)
        salt = np.uint64(mix(np.array([b + 1], np.uint64))[0])
        g = ((mix(h ^ salt) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(groups, np.uint64)
        np.add.at(content, g, mix(h + salt))
        count = np.bincount(g, minlength=groups)
        key = mix(content ^ (np.arange(groups, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt))
        fullest = np.lexsort((key, -count))[:kept]
        out.append(key[fullest])
    return np.concatenate(out).view(np.int64)


def node_of(h: np.ndarray) -> int | None:
    """A 64-bit name of a set; None for the empty set."""
    if not len(h):
        return None
    x = int(np.add.reduce(mix(h + np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)) + 0x9E3779B97F4A7C15 * len(h) & _MASK
    return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def group_counts(h: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((mix(h) >> np.uint64(40)).astype(np.int64) % groups, minlength=groups).astype(np.uint32)


def fine_counts(h: np.ndarray) -> np.ndarray:
    """Counts by as many coordinates as the set needs, a power of two times GROUPS; ``folded`` makes fewer of them."""
    groups = GROUPS
    while len(h) > LOAD * groups:
        groups *= 2
    return group_counts(h, groups)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(-1, groups).sum(axis=0, dtype=np.uint32)


class Bounds:
    """Upper bounds of the overlaps of nodes with fine counts of any lengths: two nodes meet at the shorter one's coordinates."""

    def __init__(self, counts: list[np.ndarray]) -> None:
        self.width = np.array([len(c) for c in counts], np.int64)
        self.row, self.table = {}, {}
        for w in np.unique(self.width).tolist():
            wide = np.flatnonzero(self.width >= w)
            self.row[w] = np.full(len(counts), -1)
            self.row[w][wide] = np.arange(len(wide))
            self.table[w] = np.stack([folded(counts[i], w) for i in wide])

    def __call__(self, i: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), np.int64)
        shared = np.minimum(self.width[others], self.width[i])
        for w in np.unique(shared).tolist():
            at, row, table = shared == w, self.row[w], self.table[w]
            out[at] = np.minimum(table[row[others[at]]], table[row[i]]).sum(axis=1, dtype=np.int64)
        return out


def _texts(df: DataFrame, keep: list[str], fn, schema: str) -> DataFrame:
    source = df.select(*keep, "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            yield from fn(batch, state)

    return source.mapInArrow(run, schema)


def document_sets(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """doc_id, n_shingles and the node of every row."""

    def sets(batch: pa.RecordBatch, state: dict) -> Iterator[pa.RecordBatch]:
        each = [shingles(t, rule.words) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(h) for h in each], pa.int64()), pa.array([node_of(h) for h in each], pa.int64())], names=["doc_id", "n_shingles", "node"]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs, ["doc_id"], sets, f"doc_id {kind}, n_shingles bigint, node bigint")


SEEN = 200_000  # nodes of a task that are remembered, so that copies emit once
HELD = 1_000_000  # cells that a task joins before it sends them on


def first_of_cells(cell: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of cell and node; which of them is its cell's first, and each row's first node."""
    order = np.lexsort((node, cell))
    cell, node = cell[order], node[order]
    first = np.concatenate(([True], cell[1:] != cell[:-1]))
    return order, first, node[first][np.cumsum(first) - 1]


def cells(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """(cell, node, near): with near null, the smallest node that a run of a task's nodes has in the cell; otherwise two nodes of one cell.

    The second kind is dealt by its node.
    """

    def rows(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        cell, node = np.concatenate(keys), np.concatenate(nodes)
        order, first, hub = first_of_cells(cell, node)
        cell, node = cell[order], node[order]
        near = np.unique(np.stack((node, hub), axis=1)[node != hub], axis=0)
        cell, node = cell[first], node[first]
        by_node = np.argsort(node, kind="stable")  # equal nodes in a row: shuffle files are smaller
        cell, node = cell[by_node], node[by_node]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((cell, near[:, 0]))),
                pa.array(np.concatenate((node, near[:, 0]))),
                pa.array(np.concatenate((np.zeros(len(cell), np.int64), near[:, 1])), mask=np.arange(len(cell) + len(near)) < len(cell)),
            ],
            names=["cell", "node", "near"],
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, nodes, held = set(), [], [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                h = shingles(t, rule.words)
                node = node_of(h)
                if node is None or node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                key = cell_keys(h, rule)
                if not len(key):
                    continue
                keys.append(key)
                nodes.append(np.full(len(key), node, np.int64))
                held += len(key)
                if held >= HELD:
                    yield rows(keys, nodes)
                    keys, nodes, held = [], [], 0
        if keys:
            yield rows(keys, nodes)

    return docs.select("body").mapInArrow(emit, "cell bigint, node bigint, near bigint")


def cell_stars(members: DataFrame) -> DataFrame:
    """(a, b): edges that connect the nodes of every cell.  The members move once; each task reads its cells in order, as a stream."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_cell, last_hub = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            alone = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            node = batch.column(1).to_numpy()
            given = np.stack((batch.column(2).fill_null(0).to_numpy()[~alone], node[~alone]), axis=1)
            cell, node = batch.column(0).to_numpy()[alone], node[alone]
            if len(cell):
                _, _, hub = first_of_cells(cell, node)
                hub = np.where(cell == last_cell, last_hub, hub) if last_cell is not None else hub
                last_cell, last_hub = cell[-1], hub[-1]
                given = np.concatenate((given, np.stack((hub, node), axis=1)[hub != node]))
            if len(given):
                given = np.unique(given, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(given[:, 0]), pa.array(given[:, 1])], names=["a", "b"])

    return members.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(stars, "a bigint, b bigint").distinct()


def starred(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b and the same components: a node keeps one smaller neighbour, and its other smaller ones meet that one.

    Nodes of one group have mostly the same neighbours, so what they say about those falls together.
    """
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    least = pairs.withColumn("a", F.min("lo").over(W.partitionBy("hi")))
    return least.select("a", F.when(F.col("lo") == F.col("a"), F.col("hi")).otherwise(F.col("lo")).alias("b")).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Every node takes its smallest neighbour, then the neighbour's and so on; what hangs together becomes one node, and the edges
    between such nodes go on.  Local minima alone remain, at most half of the nodes, so an edge moves once or twice.
    Each round is written to the shared folder, so the plan stays short and survives lost executors.
    """
    rest, label = written(starred(edges), f"{name}-edges"), None
    while True:
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), f"{name}-labels")
        while True:
            jump = up.select(F.col("node").alias("mid"), F.col("root").alias("far"))
            new = written(up.withColumnRenamed("root", "mid").join(jump, "mid").select("node", F.col("mid").alias("was"), F.col("far").alias("root")), f"{name}-labels")
            up = new.select("node", "root")
            if new.filter("was <> root").isEmpty():
                break
        if label is None:
            label = up
        else:
            to = up.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            label = written(label.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), f"{name}-labels")
        ends = [up.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("a", "b")]
        moved = rest.join(ends[0], "a").join(ends[1], "b").filter("_a <> _b")
        rest = written(starred(moved.select(F.col("_a").alias("a"), F.col("_b").alias("b"))), f"{name}-edges")
        if rest.isEmpty():
            return label


class Sets:
    """The nodes of one or two leaves, with exact overlaps of all their pairs."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, sets: list[np.ndarray], rule: Rule = CONTRACT) -> None:
        self.sizes, self.counts, self.sets, self.rule = sizes, counts, sets, rule

    def pairs(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
        """Linked pairs, one row of the left side at a time; a pair that union-find has already joined is skipped."""
        parent = list(range(len(self.sizes)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in left:
            others = right[right > i]
            need = needed_overlap(self.sizes[others] + self.sizes[i], self.rule)
            others, need = (x[need <= np.minimum(self.sizes[others], self.sizes[i])] for x in (others, need))
            if not len(others):
                continue
            bound = np.minimum(self.counts[others], self.counts[i]).sum(axis=1, dtype=np.int64)
            near = bound >= need
            order = np.argsort(need[near] - bound[near], kind="stable")
            for j, least in zip(others[near][order], need[near][order], strict=True):
                if root(i) != root(j) and overlap(self.sets[i], self.sets[j]) >= least:
                    parent[root(i)] = root(j)
                    yield int(i), int(j)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def _of_nodes(docs: DataFrame, wanted: DataFrame, fn, names: list[str], schema: str, rule: Rule) -> DataFrame:
    """The columns of ``wanted`` (doc_id, node, ...) but doc_id, and what ``fn`` makes of each node's set; a row for each node.

    The set is made in the task that reads the text, and only what ``fn`` returns moves.  An id that has several texts is read for
    each of them, so the text has to give the node.
    """
    rest = [c for c in wanted.columns if c not in ("doc_id", "node")]

    def make(batch: pa.RecordBatch, state: dict) -> Iterator[pa.RecordBatch]:
        node = batch.column(0).to_pylist()
        each = [shingles(t, rule.words) for t in batch.column(batch.num_columns - 1).to_pylist()]
        same = [k for k, h in enumerate(each) if node_of(h) == node[k]]
        kept = batch.take(pa.array(same, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *fn([each[k] for k in same])], names=["node", *rest, *names])

    found = docs.select(F.col("doc_id").alias("id"), "body").join(wanted, F.col("id") == F.col("doc_id"))
    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in ["node", *rest])
    return _texts(found, ["node", *rest], make, f"{kinds}, {schema}").dropDuplicates(["node"])


def points(docs: DataFrame, wanted: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """(node, block, n, counts) of the wanted nodes: (doc_id, node, block), one document each."""

    def counted(each: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array([len(h) for h in each], pa.int64()), pa.array([fine_counts(h).tobytes() for h in each], pa.binary())]

    return _of_nodes(docs, wanted, counted, ["n", "counts"], "n bigint, counts binary", rule)


def node_sets(docs: DataFrame, wanted: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """(node, hashes) of the wanted nodes: (doc_id, node), one document each."""
    return _of_nodes(docs, wanted, lambda each: [pa.array([h.tobytes() for h in each], pa.binary())], ["hashes"], "hashes binary", rule)


def leaves(nodes: DataFrame) -> DataFrame:
    """Packs the nodes of each block into leaves: all nodes sorted by block, size and coordinates, cut into runs of nodes.

    A leaf is named by the rank of its run's start, which does not fall along the order of a block.
    """
    key = nodes.select("block", "n", F.substring("counts", 1, 32).alias("head"), "node")
    run = F.when(F.col("n") <= SMALL_SET, 4 * LEAF).otherwise(LEAF)
    number = in_order(key, ["block", "n", "head", "node"], "jaccard-order").select(
        F.col("node").alias("_node"), (F.col("rank") - F.col("rank") % run).cast("bigint").alias("leaf")
    )
    return nodes.join(number, F.col("node") == F.col("_node")).drop("_node")


def leaf_pairs(packed: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """(block, leaf, pair, side) for every pair of leaves of a block that the bound leaves open; ``pair`` names it."""

    def bounding_box(t: pa.Table) -> pa.Table:
        n = t.column("n").to_numpy()
        top = np.max([folded(np.frombuffer(x, np.uint32), GROUPS) for x in t.column("counts").to_pylist()], axis=0)
        row = {"block": t.column("block")[:1], "leaf": t.column("leaf")[:1], "least": [int(n.min())], "most": [int(n.max())]}
        return pa.table(row | {"top": pa.array([top.tolist()], pa.list_(pa.int32()))})

    key = packed.select("block", "leaf", "n", "counts")
    box = key.groupBy("block", "leaf").applyInArrow(bounding_box, "block bigint, leaf bigint, least bigint, most bigint, top array<int>")
    other = box.select("block", *[F.col(c).alias(f"o_{c}") for c in ("leaf", "least", "most", "top")])
    bound = F.aggregate(F.zip_with("top", "o_top", lambda x, y: F.least(x, y)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    # Sizes: the smallest set of the later leaf against the largest of the earlier; leaves follow one another by size.
    open_pairs = box.join(other, "block").filter(
        (F.col("leaf") <= F.col("o_leaf"))
        & (rule.den * F.col("most") >= rule.num * F.col("o_least"))
        & (bound * (rule.num + rule.den) >= rule.num * (F.col("least") + F.col("o_least")))
    )
    pair = open_pairs.select("block", F.col("leaf").alias("l1"), F.col("o_leaf").alias("l2"), F.xxhash64("block", "leaf", "o_leaf").alias("pair"))
    one = pair.select("block", F.col("l1").alias("leaf"), "pair", F.lit(1).alias("side"))
    two = pair.filter("l1 <> l2").select("block", F.col("l2").alias("leaf"), "pair", F.lit(2).alias("side"))
    return one.union(two)


def met_nodes(packed: DataFrame, pairs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """(node, pair, side): the nodes of each pair of leaves that the bound leaves open against some node of the other leaf.

    Only counts move here, so that the sets, which are far larger, move for the leaves where a node may link, not for all of its block.
    """

    def bounded(batch: pa.Table) -> pa.Table:
        order = np.lexsort((batch.column("node").to_numpy(), batch.column("side").to_numpy()))
        t = batch.take(pa.array(order))
        side, n = t.column("side").to_numpy(), t.column("n").to_numpy()
        bound = Bounds([np.frombuffer(x, np.uint32) for x in t.column("counts").to_pylist()])
        first, second = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        met = np.zeros(len(n), bool)
        for i in first:
            others = second if len(second) else first[first > i]
            need = needed_overlap(n[others] + n[i], rule)
            others, need = (x[need <= np.minimum(n[others], n[i])] for x in (others, need))
            near = others[bound(i, others) >= need]
            met[near] = True
            met[i] |= len(near) > 0
        return t.select(["node", "pair", "side"]).filter(pa.array(met))

    rows = packed.select("block", "leaf", "node", "n", "counts").join(pairs, ["block", "leaf"]).select("pair", "side", "node", "n", "counts")
    return rows.groupBy("pair").applyInArrow(bounded, "node bigint, pair bigint, side int")


def leaf_links(packed: DataFrame, pairs: DataFrame, rule: Rule = CONTRACT, sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b): links that span the linked nodes of each pair of leaves.

    ``sets_of`` makes (node, hashes) for a table of nodes; without it the packed nodes have their hashes.
    """

    def join_leaves(batch: pa.Table) -> pa.Table:
        order = np.lexsort((batch.column("node").to_numpy(), batch.column("side").to_numpy()))
        t = batch.take(pa.array(order))
        side, node = t.column("side").to_numpy(), t.column("node").to_numpy()
        each = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        sets = Sets(np.array([len(h) for h in each]), np.stack([group_counts(h) for h in each]).astype(np.int64), each, rule)
        first, second = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        found = list(sets.pairs(first, second if len(second) else first))
        return pa.table({"a": pa.array([int(node[i]) for i, _ in found], pa.int64()), "b": pa.array([int(node[j]) for _, j in found], pa.int64())})

    met = written(met_nodes(packed, pairs, rule), "jaccard-met")
    sets = sets_of(met.select("node").distinct()) if sets_of else packed.select("node", "hashes")
    return sets.join(met, "node").select("pair", "side", "node", "hashes").groupBy("pair").applyInArrow(join_leaves, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = CONTRACT) -> DataFrame:
    """One row per row of ``docs``: the id (as doc_id), n_shingles, component_id."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    sets = written(document_sets(source, rule), "jaccard-sets")
    first = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    blocks = components(cell_stars(cells(source, rule)), "jaccard-blocks")
    wanted = first.join(blocks, "node").select("doc_id", "node", F.col("root").alias("block"))
    packed = written(leaves(written(points(source, wanted, rule), "jaccard-points")), "jaccard-leaves")
    of_nodes = lambda nodes: node_sets(source, first.join(nodes, "node").select("doc_id", "node"), rule)
    links = leaf_links(packed, leaf_pairs(packed, rule), rule, of_nodes)

    # Components over nodes; the smallest id of a component's documents names it.
    roots = components(links, "jaccard-links")
    named = first.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc_id")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = named.select("node", "root").join(smallest, "root").select(F.col("node").alias("_node"), "component_id")
    return sets.join(of_node, F.col("node") == F.col("_node"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = NEAR) -> DataFrame:
    """The rows and columns of the document with the smallest id of each component; of equal rows (id and text) one stays.

    Rows without an id stay.
    """
    gone_id, copy = fresh(docs, "gone_id"), fresh(docs, "copy_number")
    gone = jaccard_components(docs, id_col, text_col, rule).filter("component_id <> doc_id").select(F.col("doc_id").alias(gone_id)).distinct()
    kept = docs.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")

    # Ids and hashes tell which rows are there more than once; texts move for those alone.  Rows of one id go or stay together.
    same_id, same_text = fresh(docs, "same_id"), fresh(docs, "same_text")
    keys = docs.select(F.col(id_col).alias(same_id), F.xxhash64(text_col).alias(same_text)).groupBy(same_id, same_text)
    repeated = written(keys.agg(F.count(F.lit(1)).alias(copy)).filter(F.col(copy) > 1).drop(copy), "jaccard-repeated")
    match = F.col(id_col).eqNullSafe(F.col(same_id)) & (F.xxhash64(text_col) == F.col(same_text))
    number = F.row_number().over(W.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.lit(1)))
    one = kept.join(repeated, match, "left_semi").withColumn(copy, number).filter(F.col(copy) == 1).drop(copy)
    return kept.join(repeated, match, "left_anti").union(one)
