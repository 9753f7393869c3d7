"""Whitening of embeddings by the leading eigenvectors of their covariance, found by a block Jacobi-Davidson iteration.

The covariance is never formed: ``products`` takes a block of vectors U through the table and returns V U = sum c (c . U) / n, c the centred
rows, one Spark job for the whole block.  Entries become whole numbers x, n and the sums S are exact, and so is n * x - S before it is rounded
once to a double: nothing is lost to a mean far from zero.

Each outer step is a Rayleigh-Ritz projection on the search space.  A pair whose residual has reached ``TOLERANCE`` times the largest eigenvalue is
locked: it stays in the space and gets no further correction.  Every other pair of the block gets a correction t from the
projected equation (I - Q Q')(V - e I)(I - Q Q') t = -r, Q all Ritz vectors of the block, by ``INNER`` steps of MINRES; the
equations of all pairs move in step, so that a MINRES step is one job for all of them.  The space is cut back to the Ritz vectors of the block
when it would pass ``SPACE`` blocks.  It ends when all wanted pairs are locked, or the space is the whole space.

The driver holds arrays of dimension x at most SPACE * (COMPONENTS + GUARD) numbers, whatever the number of rows; each task
returns dimension x block sums, which are added up by key before they reach it.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped; vectors of another length than the most common one (ties:
the longer) as well, and empty ones; entries beyond 2^62 / 64 in size count as that; components of no variance (eigenvalue at most
dimension * 2^-52 of the largest) do not exist, so equal rows, a single row and an empty table give an empty result; a deviation that a
long cannot hold is null; repeated rows and null ids are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcheck.llm.common import pa_type, written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
GUARD = 8  # pairs iterated beyond the wanted ones, so that none is missed
SPACE = 3  # blocks
INNER = 6  # MINRES steps
INNER_TOLERANCE = 1e-3
OUTER = 100
TOLERANCE = 2.0**-43
SEED = 13


class Fit(NamedTuple):
    n: int
    sums: list[int]  # exact, by dimension


class Components(NamedTuple):
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # dimension x components
    residuals: np.ndarray
    products: int  # passes over the rows


def whole_entries(embeddings: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, x): the remaining rows with their entries as whole numbers."""
    ok = F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = lambda c: F.least(F.greatest(c.cast("double") * SCALE, F.lit(-(2.0**62))), F.lit(2.0**62))
    rows = embeddings.filter(F.coalesce(ok, F.lit(False)) & (F.size(vector) > 0))
    return rows.select(F.col(key).alias("key"), F.transform(vector, lambda c: F.floor(scaled(c)) + OFFSET).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _spread(x: np.ndarray, fit: Fit) -> np.ndarray:
    """n * x - S, exact: int64 where it fits, else Python's integers."""
    most = max(int(x.max()), -int(x.min())) * fit.n + max(map(abs, fit.sums))
    if most < 1 << 62:
        return x * np.int64(fit.n) - np.array(fit.sums, np.int64)
    return x.astype(object) * fit.n - np.array(fit.sums, object)


def _centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    return (_spread(x, fit) / fit.n).astype(np.float64)


def _sums(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of the arrays that ``of`` returns for blocks of rows: by task, then by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch))
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "v"])

    cells = rows.select("x").mapInArrow(run, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(shape[0] * shape[1])
    out[cells["cell"].to_numpy()] = cells["v"].to_numpy()
    return out.reshape(shape)


def fit_sums(rows: DataFrame, dimension: int) -> Fit:
    """The number of rows and the sum of each dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimension
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                small = max(int(x.max()), -int(x.min())) * len(x) < 1 << 62
                total = [a + int(b) for a, b in zip(total, (x if small else x.astype(object)).sum(axis=0), strict=True)]
                n += len(x)
        yield pa.record_batch([pa.array(range(dimension + 1), pa.int64()), pa.array([str(v) for v in (n, *total)])], names=["cell", "v"])

    sums = rows.select("x").mapInArrow(run, "cell bigint, v string").groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    values = {r["cell"]: int(r["v"]) for r in sums}
    return Fit(values.get(0, 0), [values.get(i + 1, 0) for i in range(dimension)])


def _orthonormal(t: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What of the columns of t is outside the basis, as orthonormal columns."""
    t = t / np.maximum(np.linalg.norm(t, axis=0), np.finfo(float).tiny)
    kept = [basis[:, :0]]
    for i in range(t.shape[1]):
        v, known = t[:, i], np.hstack([basis, *kept])
        for _ in range(3):
            v = v - known @ (known.T @ v)
            size = np.linalg.norm(v)
            if size < 1e-8:
                break
            v = v / size
        else:
            kept.append(v[:, None])
    return np.hstack(kept)


def _minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray) -> np.ndarray:
    """Solutions of one symmetric equation per column, in step."""
    size = np.linalg.norm(b, axis=0)
    v, v_old, x = b / np.where(size > 0, size, 1), np.zeros_like(b), np.zeros_like(b)
    w, w_old = np.zeros_like(b), np.zeros_like(b)
    beta, eta = np.zeros(b.shape[1]), size.copy()
    c, c_old, s, s_old = np.ones(b.shape[1]), np.ones(b.shape[1]), np.zeros(b.shape[1]), np.zeros(b.shape[1])
    for _ in range(INNER):
        av = apply(v)
        alpha = (v * av).sum(axis=0)
        v_new = av - alpha * v - beta * v_old
        beta_new = np.linalg.norm(v_new, axis=0)
        r0, r2, r3 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        r1 = np.hypot(r0, beta_new)
        safe = np.where(r1 > 0, r1, 1)
        c_old, s_old, c, s = c, s, r0 / safe, beta_new / safe
        w_old, w = w, np.where(r1 > 0, (v - r3 * w_old - r2 * w) / safe, 0)
        x, eta = x + c * eta * w, -s * eta
        v_old, v, beta = v, v_new / np.where(beta_new > 0, beta_new, 1), beta_new
        if (np.abs(eta) <= INNER_TOLERANCE * size).all():
            break
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dimension: int, wanted: int) -> Components:
    """The largest eigenpairs of a symmetric positive operator that is known by its products with blocks of vectors."""
    wanted, passes = min(wanted, dimension), 0
    block = min(dimension, wanted + GUARD)
    rng = np.random.default_rng(SEED)

    def multiply(u: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(u)

    space = _orthonormal(rng.standard_normal((dimension, block)), np.zeros((dimension, 0)))
    image = multiply(space)
    for _ in range(OUTER):
        h = space.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, ritz_image = space @ y, image @ y
        residual = ritz_image - ritz * theta
        size = np.linalg.norm(residual, axis=0)
        locked = size <= TOLERANCE * max(theta[0], 0)
        if locked[:wanted].all() or space.shape[1] == dimension:
            break
        q, e = ritz[:, :block], theta[:block]
        todo = np.flatnonzero(~locked[:block])
        outside = lambda t: t - q @ (q.T @ t)
        t = _minres(lambda v: outside(multiply(v) - v * e[todo]), -outside(residual[:, todo]))  # noqa: B023
        if space.shape[1] + len(todo) > max(SPACE * block, 2 * block) and SPACE * block < dimension:
            space, image = q, ritz_image[:, :block]
        new = _orthonormal(t, space)
        if not new.shape[1]:  # corrections inside the space: go on with fresh directions
            new = _orthonormal(rng.standard_normal((dimension, min(block, dimension - space.shape[1]))), space)
        space, image = np.hstack([space, new]), np.hstack([image, multiply(new)])
    return Components(theta[:wanted], ritz[:, :wanted], size[:wanted], passes)


def principal(rows: DataFrame, fit: Fit, wanted: int) -> Components:
    """The leading components of the covariance of the rows' entries."""
    d = len(fit.sums)

    def product(u: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            c = _centred(x, fit)
            return c.T @ (c @ u)

        return _sums(rows, of, u.shape) / fit.n

    found = jacobi_davidson(product, d, wanted)
    there = found.values > max(found.values[0], 0) * d * 2.0**-52
    return Components(found.values[there], found.vectors[:, there], found.residuals[there], found.products)


def whiten(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, residual): each remaining row on each component."""
    entries = whole_entries(embeddings, vector, key)
    kind = entries.schema["key"].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, residual double"
    rows = written(entries, "whitening-entries")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not common:
        return embeddings.sparkSession.createDataFrame([], schema)
    d = common[0]["d"]
    rows = rows.filter(F.size("x") == d)
    fit = fit_sums(rows, d)
    found = principal(rows, fit, components)
    k = len(found.values)
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    scaled = found.vectors / np.sqrt(found.values)

    def moments(x: np.ndarray) -> np.ndarray:
        c = _centred(x, fit)
        w = c @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0), np.full(k, (c * c).sum())])

    m = _sums(rows, moments, (k + 2, k)) / fit.n
    error = float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())
    explained, residual = found.values / m[k + 1, 0], found.residuals / found.values[0]
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x = _matrix(batch)
                b, y = len(x), _spread(x, fit)
                w = (y / fit.n).astype(np.float64) @ scaled
                fits = y.dtype != object and int(np.abs(y).max()) ** 2 * d < 1 << 63
                squares = (y * y).sum(axis=1) if fits else [v if (v := sum(int(a) * int(a) for a in r)) < 1 << 63 else None for r in y]
                of = pa.array(np.repeat(np.arange(b), k))
                columns = [
                    batch.column("key").take(of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b)), pa.array(np.full(b * k, fit.n)),
                    pa.array(squares, pa.int64()).take(of), pa.array(w.ravel()), pa.array(np.tile(explained, b)), pa.array(np.full(b * k, error)),
                    pa.array(np.tile(residual, b)),
                ]
                yield pa.record_batch(columns, names=names)

    return rows.mapInArrow(run, schema)
