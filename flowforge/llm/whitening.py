"""Embedding whitening: leading covariance eigenvectors by block Jacobi-Davidson.

Method
------
1. Entries become whole numbers ``floor(scale * c) + shift``; the fit list is every
   distinct vector once.  Its number n and sums S are added up exactly.
2. The covariance V is never formed.  A product V B with a block B of columns is one
   Spark job: every partition of the fit list gives ``Xc' (Xc B)`` of its centred
   rows (``x - S/n``, the whole part subtracted in integers), and the partial products,
   added up in a fixed order, are one small array at the driver: dimensions x columns,
   whatever the number of rows.
3. Rayleigh-Ritz on the search space gives Ritz pairs; leading pairs whose residual
   has reached double precision are locked and leave the search space.
4. For the others the correction equations, projected off the locked and the wanted
   Ritz vectors, are solved by MINRES: all columns advance together, one product a step.
   The corrections are orthonormalised into the space, which restarts from its leading
   Ritz vectors when it is full.
5. A last Rayleigh-Ritz over the locked vectors with a fresh product, whose residuals
   are checked; then all rows are projected where they are read.

Every job reads the checkpointed fit list, so a lost executor costs its partitions only.

Defined results: a null vector, or one with a null, NaN, infinite or huge (2^46 or
beyond) entry, is left out; so are vectors of another length than the commonest one
(of several, the longest) and empty ones.  Equal rows are answered each and fitted
once; null ids are answered too.  Components whose eigenvalue is zero in double
precision do not exist: equal vectors only, one vector or an empty table give no
rows.  ``deviation`` is null where it exceeds 64 bits.  Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowforge.llm.common import materialize

EPS = float(np.finfo(np.float64).eps)
#: Partial sums that come to the driver for one product, at most.
MERGE_GROUPS = 64
BLOCK_ROWS = 4096
PARTITION_BYTES = 8 << 20


# ------------------------------------------------------------------ integers

def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: float, shift: int) -> tuple[DataFrame, int]:
    """((id, x array<long>) of the usable rows, their dimension; 0 without rows)."""
    v = F.col(vector)
    usable = v.isNotNull() & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < 2.0 ** 46, F.lit(False)))
    x = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift).cast("long"))
    rows = df.filter(usable & (F.size(v) > 0)).select(F.col(vec_id).alias("id"), x.alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), F.desc("d")).first()
    dim = common["d"] if common else 0
    return rows.filter(F.size("x") == dim), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def fit_blocks(rows: DataFrame, dim: int) -> DataFrame:
    """Every distinct vector once, some thousand in a row (rows long, x binary)."""
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, BLOCK_ROWS):
                x = _matrix(b.column(0).slice(a, BLOCK_ROWS), dim)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()),
                                                  pa.array([x.tobytes()], pa.binary())], names=["rows", "x"])

    return rows.select("x").distinct().mapInArrow(run, "rows long, x binary")


# ------------------------------------------------------------- distributed sums

def summed(blocks: DataFrame, partial: Callable[[np.ndarray], np.ndarray], dim: int,
           dtype=np.float64) -> np.ndarray | None:
    """Sum of ``partial(x)`` over all blocks, in a fixed order: inside a partition as
    the blocks stand, then partitions by number, in at most ``MERGE_GROUPS`` groups."""
    kind = np.dtype(dtype)

    def run(batches):
        from pyspark import TaskContext
        total = None
        for b in batches:
            for blob in b.column(0):
                got = partial(np.frombuffer(blob.as_py(), np.int64).reshape(-1, dim))
                total = got if total is None else total + got
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part % MERGE_GROUPS], pa.int32()), pa.array([part], pa.int32()),
                 pa.array([np.ascontiguousarray(total, kind).tobytes()], pa.binary())], names=["g", "part", "sums"])

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        total = sum(np.frombuffer(s.as_py(), kind) for s in t.column("sums"))
        return pa.table({"g": t.column("g").slice(0, 1).combine_chunks(),
                         "sums": pa.array([total.tobytes()], pa.binary())})

    parts = blocks.select("x").mapInArrow(run, "g int, part int, sums binary")
    if blocks.rdd.getNumPartitions() > MERGE_GROUPS:
        parts = parts.groupBy("g").applyInArrow(merge, "g int, sums binary")
    got = parts.select("g", "sums").collect()
    if not got:
        return None
    return sum(np.frombuffer(r["sums"], kind) for r in sorted(got, key=lambda r: r["g"]))


@dataclass(frozen=True)
class Centre:
    """n vectors with sums S, as S = n * whole + rest."""
    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n


def exact_centre(blocks: DataFrame, dim: int) -> Centre | None:
    def partial(x):  # halves, so that no sum leaves 64 bits
        return np.concatenate([[len(x)], (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)])

    got = summed(blocks, partial, dim, np.int64)
    if got is None:
        return None
    n, got = int(got[0]), got[1:].tolist()
    sums = [(a << 26) + b for a, b in zip(got[:dim], got[dim:])]
    return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


# ------------------------------------------------------------- Jacobi-Davidson

def _orthonormal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span t off the given orthonormal columns; what is
    spanned already is left out."""
    base = np.concatenate(against, axis=1)
    out = np.empty((len(t), 0))
    for col in t.T:
        size = np.linalg.norm(col)
        for _ in range(3):  # twice is enough; the third settles nearly dependent ones
            col = col - base @ (base.T @ col)
            col = col - out @ (out.T @ col)
        left = np.linalg.norm(col)
        if left > 1e-10 * size and len(t) > base.shape[1] + out.shape[1]:
            out = np.concatenate([out, (col / left)[:, None]], axis=1)
    return out


def minres(product, shifts: np.ndarray, off: np.ndarray, rhs: np.ndarray, steps: int, accuracy: float) -> np.ndarray:
    """Solutions t_j of ``P (V - shift_j) P t = rhs_j`` with P the projection off the
    orthonormal columns ``off``; all columns advance together."""
    def project(y):
        for _ in range(2):
            y = y - off @ (off.T @ y)
        return y

    v = project(rhs)
    beta = np.linalg.norm(v, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v, before = v / first, np.zeros_like(v)
    eta, beta_v = beta.copy(), np.zeros(v.shape[1])
    c, s = np.ones((2, v.shape[1])), np.zeros((2, v.shape[1]))  # last two rotations
    w, w1, x = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    live = beta > 0
    for _ in range(steps):
        if not live.any():
            break
        at = np.flatnonzero(live)
        y = project(product(v[:, at]) - v[:, at] * shifts[at])
        alpha = (v[:, at] * y).sum(axis=0)
        y = y - v[:, at] * alpha - before[:, at] * beta_v[at]
        norm = np.linalg.norm(y, axis=0)
        # rotate the new column of the tridiagonal matrix
        delta = c[1, at] * alpha - c[0, at] * s[1, at] * beta_v[at]
        rho2 = s[1, at] * alpha + c[0, at] * c[1, at] * beta_v[at]
        rho3 = s[0, at] * beta_v[at]
        rho1 = np.hypot(delta, norm)
        ok = rho1 > 0
        safe = np.where(ok, rho1, 1.0)
        new_c, new_s = delta / safe, norm / safe
        new_w = (v[:, at] - w1[:, at] * rho3 - w[:, at] * rho2) / safe
        x[:, at] += np.where(ok, new_c * eta[at], 0.0) * new_w
        eta[at] = -new_s * eta[at]
        w1[:, at], w[:, at] = w[:, at], new_w
        c[0, at], c[1, at], s[0, at], s[1, at] = c[1, at], new_c, s[1, at], new_s
        before[:, at] = v[:, at]
        v[:, at] = y / np.where(norm > 0, norm, 1.0)
        beta_v[at] = norm
        live[at] = ok & (norm > 1e-14 * first[at]) & (np.abs(eta[at]) > accuracy * first[at])
    return project(x)


def jacobi_davidson(product, dim: int, wanted: int, steps: int = 8, max_rounds: int = 200,
                    seed: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors, residual norms) of the ``wanted`` largest.

    ``product`` gives V B for a block B.  A pair has converged when its residual is
    below ``16 sqrt(dim)`` units of rounding of the largest eigenvalue: the error of one
    product in double precision."""
    wanted = min(wanted, dim)
    room = min(dim, max(4 * wanted, 24))
    locked, values = np.empty((dim, 0)), np.empty(0)
    none = np.empty((dim, 0))
    space = _orthonormal(np.random.default_rng(seed).standard_normal((dim, min(dim, 2 * wanted))), none)
    images = product(space)
    top = 0.0
    for _ in range(max_rounds):
        h = space.T @ images
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        space, images = space @ y, images @ y
        top = max([top, *np.abs(theta)])
        limit = 16 * np.sqrt(dim) * EPS * top
        open_ = wanted - len(values)
        residual = images[:, :open_] - space[:, :open_] * theta[:open_]
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        done = int(np.argmax(np.r_[norms > limit, True]))  # leading pairs only: none is passed over
        if done:
            locked = np.concatenate([locked, space[:, :done]], axis=1)
            values = np.r_[values, theta[:done]]
            space, images, theta, residual = space[:, done:], images[:, done:], theta[done:], residual[:, done:]
            open_ -= done
        if not open_:
            break
        if space.shape[1] + open_ > room:  # restart from the leading Ritz vectors
            space, images = space[:, :2 * open_], images[:, :2 * open_]
        ritz = space[:, :open_]
        fix = minres(product, theta[:open_], np.concatenate([locked, ritz], axis=1), -residual, steps, 1e-3)
        more = _orthonormal(np.concatenate([fix, residual], axis=1), locked, space)[:, :open_]
        if not more.shape[1]:  # the whole space: rounding alone is left
            fresh = _orthonormal(space, locked)
            space, images = fresh, product(fresh)
            h = space.T @ images
            theta, y = np.linalg.eigh((h + h.T) / 2)
            locked = np.concatenate([locked, (space @ y[:, ::-1])[:, :open_]], axis=1)
            break
        space = np.concatenate([space, more], axis=1)
        images = np.concatenate([images, product(more)], axis=1)
    else:
        raise RuntimeError(f"eigenvectors have not settled in {max_rounds} rounds")
    u = np.linalg.qr(locked)[0]
    image = product(u)
    h = u.T @ image
    theta, y = np.linalg.eigh((h + h.T) / 2)
    theta, y = theta[::-1], y[:, ::-1]
    u, image = u @ y, image @ y
    return theta, u, np.linalg.norm(image - u * theta, axis=0)


# ------------------------------------------------------------------- whitening

@dataclass(frozen=True)
class Whitening:
    centre: Centre
    values: np.ndarray       # eigenvalues, falling
    vectors: np.ndarray      # unit eigenvectors as columns
    residuals: np.ndarray    # of the eigenpairs
    trace: float
    identity_error: float


def fit_whitening(rows: DataFrame, dim: int, components: int) -> Whitening | None:
    """Fitted on the distinct vectors of (x array<long>) rows; None where nothing varies."""
    if not dim:
        return None
    blocks = materialize(fit_blocks(rows, dim))
    size = blocks.agg(F.sum(F.octet_length("x").cast("long"))).first()[0] or 0
    # tasks in proportion to the data, however finely the vectors were dealt to be told apart
    blocks = blocks.coalesce(max(1, -(-size // PARTITION_BYTES))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centre = exact_centre(blocks, dim)
        if centre is None:
            return None
        sc = rows.sparkSession.sparkContext

        def product(b):
            sent = sc.broadcast((centre, np.ascontiguousarray(b)))

            def partial(x):
                c, cols = sent.value
                own = c.centred(x)
                return own.T @ (own @ cols)
            out = summed(blocks, partial, dim).reshape(b.shape) / centre.n
            sent.unpersist()
            return out

        trace = float(summed(blocks, lambda x: np.array([(centre.centred(x) ** 2).sum()]), dim)[0]) / centre.n
        if not trace > 0:
            return None
        values, vectors, residuals = jacobi_davidson(product, dim, components)
        real = values > 16 * dim * EPS * values[0]
        values, vectors, residuals = values[real], vectors[:, real], residuals[real]
        k = len(values)
        to = vectors / np.sqrt(values)

        def second_moment(x):
            z = centre.centred(x) @ to
            return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

        got = summed(blocks, second_moment, dim) / centre.n
        mean, cov = got[:k], got[k:].reshape(k, k)
        error = float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())
        return Whitening(centre, values, vectors, residuals, trace, error)
    finally:
        blocks.unpersist()


OUTPUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16,
           scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """Per usable row and component (numbered from 1): n, deviation, whitened, explained
    and identity_error (see ``fit_whitening``)."""
    spark = df.sparkSession
    id_type = df.schema[vec_id].dataType.simpleString()
    rows, dim = whole_vectors(df, vec_id, vector, scale, shift)
    model = fit_whitening(rows, dim, components)
    if model is None:
        return spark.createDataFrame([], f"id {id_type}, {OUTPUT}").withColumnRenamed("id", vec_id)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        n, k = m.centre.n, len(m.values)
        to = m.vectors / np.sqrt(m.values)
        for b in batches:
            for a in range(0, b.num_rows, BLOCK_ROWS):
                x = _matrix(b.column(1).slice(a, BLOCK_ROWS), dim)
                z = m.centre.centred(x) @ to
                y = (x - m.centre.whole).astype(np.float64) * n  # how large the exact sum will be
                fits = (y * y).sum(axis=1) < 2.0 ** 62
                y = n * (x - m.centre.whole) - m.centre.rest
                away = pa.array((y * y).sum(axis=1), pa.int64(), mask=~fits)
                row = pa.array(np.repeat(np.arange(len(x)), k))
                size = len(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, BLOCK_ROWS).take(row),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(size, n, np.int64)), away.take(row), pa.array(z.ravel()),
                     pa.array(np.tile(m.values / m.trace, len(x))),
                     pa.array(np.full(size, m.identity_error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"id {id_type}, {OUTPUT}").withColumnRenamed("id", vec_id)
