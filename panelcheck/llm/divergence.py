"""How much the sources of a language differ in their words: exact term counts by a sort of token-start pointers.

Each task holds texts as one Arrow buffer and points at the start of every term.  A multikey quicksort orders the pointers of a slice
(``SLICE`` bytes) by eight bytes at a time: three-way partitions, the middle part moves on to the next eight bytes, and parts below
``SMALL`` pointers are finished by one sort each.  A run of equal terms is then one term of the slice: its length by source is the
count, its different documents are the document frequency.  Only those sums are shuffled, by language and term.

A language keeps the terms of at least ``MIN_DOCS`` of its documents.  With V kept terms, a group's (or the language's) p of a term is
1 + floor(SCALE * (count + 1) / (N + V)), N its occurrences of kept terms, in exact integers.  The divergence of p from q at a term
is floor((p - q)^2 / q).

Pairs of sources: sources are numbered and taken in blocks of ``BLOCK``; a task adds up all pairs of two blocks over a slice of
at most some ``TERMS`` terms, so only sums by pair leave it.  Terms that neither block has all give the same value, which
is multiplied, not added up.

Defined results: a null text, language or source is ''; a text without terms counts for its group only; repeated rows are documents of their
own; ties of value are ordered by item; a text of any length is taken whole, in pieces of a slice that end between terms; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcheck.llm.common import written

SLICE = 12 << 20  # bytes of text that one sort takes
SMALL = 8192  # pointers that one sort by key finishes
MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
BLOCK = 32  # sources
TERMS = 16_384  # terms of a language that one task compares

# A-Z in lower case, a-z and all bytes of characters beyond ASCII; 0 for what stands between terms.
_FOLD = np.zeros(256, np.uint8)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256, dtype=np.uint8)
_TOP = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], np.uint64)  # the first k bytes of eight


class Pointers:
    """The terms of a buffer, as pointers to their starts."""

    def __init__(self, folded: np.ndarray, borders: np.ndarray):
        """``folded``: bytes with zeros between terms; ``borders``: where each document begins, and the end of the last."""
        inside = folded != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = borders[:-1][borders[:-1] < len(folded)]
        first[at] |= inside[at]
        last = inside.copy()
        last[:-1] &= first[1:] | ~inside[1:]
        kind = np.int32 if len(folded) < 1 << 31 else np.int64
        self.start = np.flatnonzero(first).astype(kind)
        self.size = np.flatnonzero(last).astype(kind) + kind(1) - self.start
        self.doc = (np.searchsorted(borders, self.start, side="right") - 1).astype(kind)
        self.bytes = np.concatenate([folded, np.zeros(8, np.uint8)])
        self._eight = np.ndarray((len(folded) + 1,), ">u8", self.bytes, strides=(1,))

    def keys(self, pointers: np.ndarray, depth) -> np.ndarray:
        """Bytes depth to depth + 8 of each term as one number; zeros where the term is over."""
        left = np.clip(self.size[pointers] - depth, 0, 8)
        at = np.minimum(self.start[pointers] + depth, len(self._eight) - 1)
        return self._eight[at].astype(np.uint64) & _TOP[left]

    def term(self, pointer: int) -> bytes:
        return self.bytes[self.start[pointer] : self.start[pointer] + self.size[pointer]].tobytes()

    def sorted_runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pointers in the order of their terms, and the number of the run of equal terms that each is in."""
        n = len(self.start)
        order, begins = np.arange(n, dtype=self.start.dtype), np.zeros(n, bool)
        key = self.keys(order, 0)
        parts, short = [(0, n, 0)] if n else [], []  # a term that eight zero bytes end is over
        while parts:
            lo, hi, depth = parts.pop()
            if hi - lo <= SMALL:
                short.append((lo, hi, depth))
                continue
            k = key[lo:hi]
            pivot = np.sort(k[:: (hi - lo) // 33])[16]
            below, same, above = np.flatnonzero(k < pivot), np.flatnonzero(k == pivot), np.flatnonzero(k > pivot)
            to = np.concatenate([below, same, above])
            order[lo:hi], key[lo:hi] = order[lo:hi][to], k[to]
            a, b = lo + len(below), hi - len(above)
            if below.size:
                parts.append((lo, a, depth))
            if above.size:
                parts.append((b, hi, depth))
            if int(pivot) & 255:
                key[a:b] = self.keys(order[a:b], depth + 8)
                parts.append((a, b, depth + 8))
            else:
                begins[a] = True
        for lo, hi, _ in short:
            to = np.argsort(key[lo:hi], kind="stable")
            order[lo:hi], key[lo:hi] = order[lo:hi][to], key[lo:hi][to]
        self._finish(order, key, begins, short)
        return order, np.cumsum(begins) - 1

    def _finish(self, order: np.ndarray, key: np.ndarray, begins: np.ndarray, short: list[tuple[int, int, int]]) -> None:
        """Parts that are in order by their present eight bytes: all equal stretches go on together, eight bytes a round."""
        if not short:
            return
        lo, hi, depth = (np.array(x, order.dtype) for x in zip(*short, strict=True))
        by = np.argsort(lo)
        lo, hi, depth = lo[by], hi[by], depth[by]
        place = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]).astype(order.dtype), hi - lo) + np.arange((hi - lo).sum(), dtype=order.dtype)
        deep, part = np.repeat(depth, hi - lo), np.repeat(np.arange(len(lo), dtype=order.dtype), hi - lo)
        while place.size:
            k = key[place]
            new = np.ones(len(place), bool)
            new[1:] = (k[1:] != k[:-1]) | (part[1:] != part[:-1])
            begins[place[new]] = True
            part = np.cumsum(new, dtype=order.dtype) - order.dtype.type(1)
            go = ((k & np.uint64(255)) != 0) & (np.bincount(part)[part] > 1)
            place, part, deep = place[go], part[go], deep[go] + 8
            if not place.size:
                return
            k = self.keys(order[place], deep)
            to = np.lexsort((k, part))  # parts stay where they are
            order[place], key[place] = order[place][to], k[to]


def slice_counts(text: pa.LargeStringArray, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a slice, and by (term, group) the index of both, occurrences and documents; ``group``: of each text."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    p = Pointers(_FOLD[raw], offsets - offsets[0])
    order, run = p.sorted_runs()
    if not order.size:
        return [], *[np.zeros(0, np.int64)] * 4
    groups, docs = int(group.max()) + 1, len(text)
    doc = p.doc[order]
    pair, count = np.unique(run * groups + group[doc], return_counts=True)
    each = np.unique(run * docs + doc)
    _, in_docs = np.unique(each // docs * groups + group[each % docs], return_counts=True)
    first = np.flatnonzero(np.diff(run, prepend=-1))
    return [p.term(i) for i in order[first]], pair // groups, pair % groups, count, in_docs


def _pieces(text: pa.LargeStringArray) -> Iterator[pa.LargeStringArray]:
    """One long text in pieces of about a slice, cut behind a byte that is in no term."""
    raw = text[0].as_buffer()
    between, lo = np.flatnonzero(_FOLD[np.frombuffer(raw, np.uint8)] == 0) + 1, 0
    while lo < raw.size:
        k = np.searchsorted(between, min(lo + SLICE, raw.size))
        hi = int(between[k]) if k < len(between) else raw.size
        yield pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, hi - lo], np.int64)), raw.slice(lo, hi - lo))
        lo = hi


def _rows(lang: pa.Array, source: pa.Array, term: list[bytes], of: np.ndarray, count: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
    terms = pa.array(term, pa.binary()).view(pa.string())
    names = ["lang", "source", "term", "n", "docs"]
    whole = pa.record_batch([lang, source, terms.take(pa.array(of)), pa.array(count, pa.int64()), pa.array(docs, pa.int64())], names=names)
    for at in range(0, whole.num_rows, 50_000):
        yield whole.slice(at, 50_000)


def shard_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each slice of a task's (lang, source, text)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        text = pa.concat_arrays(t["text"].chunks)
        both = pa.StructArray.from_arrays([pa.concat_arrays(t[c].chunks) for c in ("lang", "source")], names=["lang", "source"])
        index: dict[tuple, int] = {}
        group = np.array([index.setdefault((x["lang"], x["source"]), len(index)) for x in both.to_pylist()])
        lang, source = (pa.array(x, pa.string()) for x in zip(*index, strict=True))
        terms, of, g, count, docs = slice_counts(text, group)
        yield from _rows(lang.take(pa.array(g)), source.take(pa.array(g)), terms, of, count, docs)

    for batch in batches:
        batch = batch.set_column(2, "text", batch.column(2).cast(pa.large_string()))
        upto = np.cumsum(np.diff(np.frombuffer(batch.column(2).buffers()[1], np.int64)[batch.column(2).offset :][: batch.num_rows + 1]) + 64)
        lo = 0
        while lo < batch.num_rows:
            done = upto[lo - 1] if lo else 0
            hi = int(np.searchsorted(upto, done + SLICE - size, side="right"))
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                size += int(upto[hi - 1] - done)
                lo = hi
            elif held:
                yield from flush()
                held, size = [], 0
            else:  # one text of more than a slice: its pieces are added up, and it is one document
                total: Counter[bytes] = Counter()
                for piece in _pieces(batch.column(2).slice(lo, 1)):
                    terms, of, _, count, _ = slice_counts(piece, np.zeros(1, np.int64))
                    for i, c in zip(of.tolist(), count.tolist(), strict=True):
                        total[terms[i]] += c
                own = [pa.array([batch.column(i)[lo].as_py()] * len(total), pa.string()) for i in (0, 1)]
                yield from _rows(*own, list(total), np.arange(len(total)), np.array(list(total.values()), np.int64), np.ones(len(total), np.int64))
                lo += 1
    if held:
        yield from flush()


def kept_terms(documents: DataFrame) -> DataFrame:
    """(lang, term, source, n, n_lang, first): occurrences of each term that its language keeps, by source where there are any.

    ``n_lang`` are those in the language; ``first`` marks one row of each term.
    """
    parts = documents.select("lang", "source", "text").mapInArrow(shard_counts, "lang string, source string, term string, n bigint, docs bigint")
    sums = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    marked = sums.withColumns(
        {"n_lang": F.sum("n").over(term), "in_docs": F.sum("docs").over(term), "first": F.col("source") == F.min("source").over(term)}
    )
    return marked.filter(F.col("in_docs") >= MIN_DOCS).select("lang", "term", "source", "n", "n_lang", "first")


def _p(count, n, v):
    """1 + floor(SCALE * (count + 1) / (n + v)), in decimals, for counts of any corpus."""
    whole = lambda c, k: c.cast(f"decimal({k},0)")
    return F.lit(1) + F.call_function("div", whole(F.lit(SCALE), 10) * whole(count + 1, 20), whole(n + v, 20))


def _divergence(p, q):
    return F.call_function("div", (p - q) * (p - q), q)


def _block_sums(table: pa.Table, size: int) -> pa.Table:
    """Divergences of all ordered pairs of sources of two blocks of ``size``, added up over the terms of one slice.

    Rows without a term name the sources of both blocks.
    """
    term = table["term"].combine_chunks().dictionary_encode()
    there = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
    sources, column = np.unique(table["place"].to_numpy(), return_inverse=True)
    p0 = np.zeros(len(sources), np.int64)
    p0[column] = table["p0"].to_numpy()
    p = np.tile(p0, (len(term.dictionary), 1))
    p[term.indices.take(pa.array(there)).to_numpy(), column[there]] = table["p"].to_numpy()[there]
    a, b, value = [], [], []
    lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
    block = sources // size
    for i in range(len(sources)):
        d = p[:, i : i + 1] - p
        f = (d * d // p).sum(axis=0)
        # inside one block all pairs, between two blocks only those that cross
        for j in np.flatnonzero((np.arange(len(sources)) != i) & ((lo == hi) | (block != block[i]))):
            a.append(int(sources[i]))
            b.append(int(sources[j]))
            value.append(int(f[j]))
    n, lang = len(a), table["lang"][0].as_py()
    return pa.table(
        {"lang": pa.array([lang] * n, pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64()), "terms": pa.array([len(term.dictionary)] * n, pa.int64())}
    )


def source_divergence(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): see the module for the measure.

    ``pair``: all other sources of the language, by the divergence over all kept terms.  ``term``: the ``TOP_TERMS`` terms that a
    source has more of than its language, by their divergence.
    """
    docs = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = written(kept_terms(docs), "divergence-terms")
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("n_of_lang"), F.sum(F.col("first").cast("bigint")).alias("v"))
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_of_source"))
    groups = (
        docs.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_of_source", "n_of_lang", "v")))
        .withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("bigint") - 1)
        .withColumn("p0", F.when(F.col("v") > 0, _p(F.lit(0), F.col("n_of_source"), F.col("v"))))
    )
    groups = written(groups, "divergence-groups")
    placed = kept.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("n_of_source"), F.col("v")))
    columns = ("lang", "source", "part", "item", "value", "rank")

    own = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        placed.withColumn("q", _p(F.col("n_lang"), F.col("n_of_lang"), F.col("v"))).filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= TOP_TERMS)
    )

    last = groups.groupBy("lang").agg((F.max("place") / BLOCK).cast("bigint").alias("last"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), c))
    slices = (F.col("v") / TERMS).cast("bigint")
    entries = placed.select("lang", "term", "place", "p", "p0", F.pmod(F.xxhash64("term"), F.lit(1) + slices).alias("slice"))
    named = groups.filter("v > 0").select("lang", F.lit(None).cast("string").alias("term"), "place", F.col("p0").alias("p"), "p0", upto(slices).alias("slice"))
    blocks = entries.unionByName(named).join(last, "lang").select("*", (F.col("place") / BLOCK).cast("bigint").alias("mine"), upto("last").alias("other"))
    size = BLOCK
    sums = (
        blocks.select("lang", "term", "place", "p", "p0", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "slice")
        .groupBy("lang", "lo", "hi", "slice").applyInArrow(lambda t: _block_sums(t, size), "lang string, a bigint, b bigint, value bigint, terms bigint")
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    )
    left = groups.select("lang", "source", "v", F.col("place").alias("a"), F.col("p0").alias("pa"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), F.col("p0").alias("pb"))
    rest = F.when(F.col("v") > 0, (F.col("v") - F.coalesce("terms", F.lit(0))) * _divergence(F.col("pa"), F.col("pb")))
    pairs = (
        left.join(right, "lang").filter(F.col("a") != F.col("b")).join(sums, ["lang", "a", "b"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + F.coalesce(rest, F.lit(0))).alias("value"))
        .withColumn("rank", F.row_number().over(own))
    )
    return pairs.select(*columns).unionByName(terms.select(*columns))
