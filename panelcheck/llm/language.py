"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram is the product of its
letters' vectors, rotated by their place; a document and a language prototype are
sums of trigram vectors, and the prototype with the largest cosine wins.
A trigram that a document holds n times weighs log2(1 + n), in sixteenths, so that one passage
repeated without end does not drown the rest; every occurrence counts.

Training adds whole-number vectors in any order, so a rerun gives the same
prototypes.  Only one vector for each language reaches the driver.

Defined results: a null text or one without a letter is ``und`` with score 0; a training
row without text or language is left out; equal cosines go to the first language in
string order; without any training row every document is ``und``; repeated rows are rows of their own;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1024
SEED = 20240501
UNKNOWN = "und"
LEAST_SCORE = 0.1  # three standard deviations of the cosine of random vectors
BLOCK_CHARS, BLOCK_DOCS = 400_000, 256
SLICE = 4096  # trigram vectors that are held at once
LETTERS = 65_536  # letter vectors that a task remembers

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def trigram_keys(text: str) -> np.ndarray:
    """Keys of the trigrams of the lower-cased text, with a blank for each run of other characters; empty without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(_letters()[c], c, 32)
    c = np.concatenate(([32], c, [32]))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    if len(c) < 3:
        return np.empty(0, np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


class Space:
    """Trigram vectors, made from letter vectors when they are needed."""

    def __init__(self, dim: int, seed: int) -> None:
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if (v := self.letters.get(code)) is None:
            if len(self.letters) >= LETTERS:
                self.letters.clear()
            v = self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
        return v

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones((len(keys), self.dim), np.int8)
        for turn, shift in ((2, 42), (1, 21), (0, 0)):
            codes, at = np.unique(keys >> shift & 0x1FFFFF, return_inverse=True)
            out *= np.roll(np.stack([self.letter(int(c)) for c in codes]), turn, axis=1)[at]
        return out

    def bundles(self, texts: list[str], groups: np.ndarray) -> np.ndarray:
        """The sums of the weighted trigram vectors of the texts of each group (numbers from 0), exact whole numbers.

        Memory beyond the texts' own trigrams is (groups + dim) x SLICE numbers.
        """
        out = np.zeros((int(groups.max()) + 1, self.dim))
        each = [np.unique(trigram_keys(t), return_counts=True) for t in texts]
        key = np.concatenate([k for k, _ in each])
        weight = np.concatenate([np.rint(16 * np.log2(1 + n)) for _, n in each])
        group = np.repeat(groups, [len(k) for k, _ in each])
        keys, at = np.unique(key, return_inverse=True)
        order = np.argsort(at, kind="stable")
        at, weight, group = at[order], weight[order], group[order]
        for low in range(0, len(keys), SLICE):
            some = keys[low : low + SLICE]
            here = slice(*np.searchsorted(at, [low, low + len(some)]))
            counts = np.bincount(group[here] * len(some) + at[here] - low, weight[here], len(out) * len(some)).reshape(len(out), -1)
            # Products of float32 are exact while a row's weights sum to less than 2 ** 24.
            kind = np.float32 if counts.sum(axis=1).max() < 1 << 24 else np.float64
            out += counts.astype(kind) @ self.vectors(some).astype(kind)
        return out


def blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of texts of bounded total length (a longer text is a run of its own)."""
    rows: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if rows and (size + len(t or "") > BLOCK_CHARS or len(rows) == BLOCK_DOCS):
            yield rows, [texts[r] or "" for r in rows]
            rows, size = [], 0
        rows.append(i)
        size += len(t or "")
    if rows:
        yield rows, [texts[r] or "" for r in rows]


def prototypes(docs: DataFrame, text_col: str, lang_col: str, dim: int = DIM, seed: int = SEED) -> dict[str, list[int]]:
    """The sum of all trigram vectors of each language's documents."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("body")).dropna()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dim, seed), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, texts in blocks(batch.column(1).to_pylist()):
                names, group = np.unique([langs[r] for r in at], return_inverse=True)
                for name, v in zip(names.tolist(), space.bundles(texts, group), strict=True):
                    sums[name] = sums.get(name, 0) + v.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"]
            )

    parts = rows.mapInArrow(partial, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("d", "x"))
    summed = parts.groupBy("lang", "d").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).select("lang", F.col("v.x").alias("v"))
    return {r["lang"]: list(r["v"]) for r in rows.orderBy("lang").collect()}  # languages x dim numbers


def classify(texts: list[str | None], names: list[str], protos: np.ndarray, space: Space) -> tuple[list[str], list[float]]:
    """Language and score of each text; ``protos`` are unit vectors."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    for at, some in blocks(texts):
        if not names:
            continue
        docs = space.bundles(some, np.arange(len(some)))
        length = np.linalg.norm(docs, axis=1)
        cosine = (docs @ protos.T) / np.maximum(length, 1e-9)[:, None]
        best, lettered = cosine.argmax(axis=1), docs.any(axis=1)
        for i, r in enumerate(at):
            if lettered[i]:
                langs[r] = names[best[i]]
                scores[r] = round(float(np.clip(cosine[i, best[i]], 0, 1)), 6)
    return langs, scores


def predict(docs: DataFrame, keep: list[str], text_col: str, protos: dict[str, list[int]], dim: int = DIM, seed: int = SEED) -> DataFrame:
    """The kept columns with lang_pred and score."""
    names, matrix = unit_rows(protos, dim)
    source = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dim, seed)
        for batch in batches:
            langs, scores = classify(batch.column(len(keep)).to_pylist(), names, matrix, space)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"]
            )

    return source.mapInArrow(run, f"{head}, lang_pred string, score double")


def unit_rows(protos: dict[str, list[int]], dim: int) -> tuple[list[str], np.ndarray]:
    """Languages in string order and their prototypes as unit vectors."""
    names = sorted(protos)
    matrix = np.array([protos[n] for n in names], np.float64).reshape(-1, dim)
    return names, (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def in_a_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows and columns of the documents that are in one of the learned languages."""
    names, matrix = unit_rows(prototypes(docs.filter(~held_out(id_col)), text_col, lang_col), DIM)

    def accepted(texts):
        import pandas as pd

        langs, scores = classify([None if t is None else str(t) for t in texts], names, matrix, Space(DIM, SEED))
        return pd.Series([a != UNKNOWN and s >= least for a, s in zip(langs, scores, strict=True)], dtype=bool)

    return docs.filter(F.pandas_udf(accepted, "boolean")(F.col(text_col)))


def held_out(id_col: str = "doc_id"):
    """Documents that training must not see."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = DIM, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: the id, held_out, lang_pred, score.  Trains on the rows that are not held out."""
    protos = prototypes(docs.filter(~held_out(id_col)), text_col, lang_col, dim, seed)
    marked = docs.select(F.col(id_col).alias(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_body"))
    return predict(marked, [id_col, "held_out"], "_body", protos, dim, seed)
