"""Embedding whitening by a bidiagonal qd solver.

Centred rows are reduced to one triangle R by QR of blocks: each task folds its rows into a triangle, triangles are folded sixteen at
a time. R has the singular values and right singular vectors of all rows. Householder reflections make it bidiagonal, dqds with
shifts from below finds the squared singular values, and twisted factorisations give a vector for each. Only matrices of
dimension x dimension ever meet in one place; rows stay where they are.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.layout import settle
from panelspark.llm.common import small_batches

MOST_COMPONENTS = 32
SCALE = 64.0
OFFSET = 1_000_000
FAN_IN = 16  # triangles that a task folds into one
EPS = np.finfo(float).eps
RANK_TOLERANCE = 64 * EPS  # a singular value below this share of the largest, times the dimension, counts as zero


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): r = u B v' with B upper bidiagonal, diagonal a, superdiagonal b; u is not kept."""
    m = np.array(r, float)
    n = len(m)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        """(w, c) with (1 - c w w') x = (s, 0, ...)."""
        scale = np.abs(x).max(initial=0.0)
        if len(x) < 2 or scale == 0 or not np.abs(x[1:]).any():
            return x, 0.0
        w = x / scale
        w[0] += math.copysign(np.linalg.norm(w), w[0])
        return w, 2.0 / (w @ w)

    for k in range(n):
        w, c = reflector(m[k:, k].copy())
        if c:
            m[k:, k:] -= np.outer(c * w, w @ m[k:, k:])
        if k < n - 2:
            w, c = reflector(m[k, k + 1 :].copy())
            if c:
                m[k:, k + 1 :] -= np.outer(m[k:, k + 1 :] @ w, c * w)
                v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ w, c * w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential qd transform; None if the shift lies above the smallest eigenvalue."""
    d = q[0] - shift
    q2, e2, ds = [], [], [d]
    for i in range(len(e)):
        if not d >= 0:
            return None
        t = d + e[i]
        q2.append(t)
        if t == 0:
            return None
        ratio = q[i + 1] / t
        e2.append(e[i] * ratio)
        d = d * ratio - shift
        ds.append(d)
    if not d >= 0:
        return None
    q2.append(d)
    return q2, e2, ds


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), falling, to high relative accuracy.

    Shifts come from below: the reciprocal sum of 1/d over an unshifted step never exceeds the smallest eigenvalue. A step whose
    rounding makes a pivot negative is taken back and tried with less. Squares below the least that doubles can tell from zero at
    the matrix' size are raised to it first, which moves no eigenvalue by more than that.
    """
    n = len(a)
    if n == 0:
        return np.zeros(0)
    size = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    if size == 0:
        return np.zeros(n)
    q = np.maximum((a / size) ** 2, EPS**3).tolist()
    e = ((b / size) ** 2).tolist()
    found: list[float] = []
    todo = [(q, e, 0.0)]
    while todo:
        q, e, moved = todo.pop()
        while q:
            # cut where a coupling is nothing beside its neighbours
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS**2 * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            plain = _qd_step(q, e, 0.0)
            if plain is None:  # a pivot vanished in rounding
                q = [max(x, EPS**3) for x in q]
                continue
            q, e, ds = plain
            tau = 1.0 / sum(1.0 / max(d, 1e-300) for d in ds)
            while tau > EPS * (moved + tau):
                shifted = _qd_step(q, e, tau)
                if shifted is not None:
                    q, e, _ = shifted
                    moved += tau
                    break
                tau *= 0.5
    return np.sort(found)[::-1] * size**2


def _twisted(a: np.ndarray, b: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """One row per eigenvalue: the vector of B'B for it, from the twisted factorisation with the smallest pivot.

    B'B = L D L' with pivots a² and multipliers b / a; top-down and bottom-up differential transforms for all eigenvalues at once.
    """
    n, k = len(a), len(lam)
    tiny = max(np.abs(a).max(), 1e-300) ** 2 * EPS * 1e-6
    fix = lambda x: np.where(np.abs(x) < tiny, np.where(x < 0, -tiny, tiny), x)
    d, ld = a**2, a[:-1] * b  # pivots of L D L' and its off-diagonal
    l = np.divide(b, a[:-1], out=np.zeros(n - 1), where=a[:-1] != 0)  # noqa: E741
    s, lower = np.empty((n, k)), np.empty((max(n - 1, 0), k))
    s[0] = -lam
    for i in range(n - 1):
        pivot = fix(d[i] + s[i])
        lower[i] = ld[i] / pivot
        s[i + 1] = lower[i] * l[i] * s[i] - lam
    p, upper = np.empty((n, k)), np.empty((max(n - 1, 0), k))
    p[n - 1] = d[n - 1] - lam
    for i in range(n - 2, -1, -1):
        pivot = fix(ld[i] * l[i] + p[i + 1])
        upper[i] = ld[i] / pivot
        p[i] = p[i + 1] * d[i] / pivot - lam
    gamma = s + p + lam
    twist = np.abs(gamma).argmin(axis=0)
    z = np.zeros((n, k))
    z[twist, np.arange(k)] = 1.0
    for i in range(n - 2, -1, -1):
        z[i] = np.where(i < twist, -lower[i] * z[i + 1], z[i])
    for i in range(n - 1):
        z[i + 1] = np.where(i + 1 > twist, -upper[i] * z[i], z[i + 1])
    return (z / np.linalg.norm(z, axis=0)).T


def bidiagonal_vectors(a: np.ndarray, b: np.ndarray, lam: np.ndarray, *, close: float = 1e-3) -> np.ndarray:
    """Orthonormal right singular vectors (rows) of the bidiagonal for squared singular values ``lam``, falling.

    Values with a relative gap under ``close`` form a cluster, whose vectors are made orthogonal to each other; where nothing of a vector
    is left, it is found by inverse iteration from a drawn start in what the cluster has not got yet.
    """
    rows = _twisted(a, b, lam)
    tri = np.diag(a**2 + np.concatenate(([0.0], b**2))) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    draw = np.random.default_rng(len(a))
    first = 0
    for i in range(len(lam)):
        if i and lam[i - 1] - lam[i] > close * lam[i - 1]:
            first = i
        done = rows[first:i]
        z = rows[i] - done.T @ (done @ rows[i])
        size = np.linalg.norm(z)
        if not size > 0.5:
            shifted = tri - (lam[i] + EPS * lam[first] * (1 + i - first)) * np.eye(len(a))
            z = draw.standard_normal(len(a))
            for _ in range(3):
                z -= done.T @ (done @ z)
                z = np.linalg.lstsq(shifted, z / np.linalg.norm(z), rcond=None)[0]
                z /= np.linalg.norm(z)
        for _ in range(2):
            z = z - done.T @ (done @ z)
            z /= np.linalg.norm(z)
        rows[i] = z
    return rows


@dataclass(frozen=True)
class Fit:
    """What one vector length has: ``n`` rows, exact ``sums``, ``values`` (eigenvalues of the covariance), ``trace``, ``vectors`` (rows)."""

    n: int
    sums: list[int]
    values: np.ndarray
    trace: float
    vectors: np.ndarray


def solve(r: np.ndarray, n: int, sums: list[int], components: int) -> Fit:
    """Eigenvalues and unit eigenvectors of r'r / n, numbered by falling eigenvalue; the sign makes the largest entry positive."""
    a, b, v = bidiagonalise(r)
    lam = dqds(a, b)
    some = lam[:components]
    live = int((some > (RANK_TOLERANCE * len(a)) ** 2 * (lam[0] if len(lam) else 0.0)).sum())
    vectors = bidiagonal_vectors(a, b, some[:live]) @ v.T if live else np.zeros((0, len(a)))
    sign = np.sign(vectors[np.arange(live), np.abs(vectors).argmax(axis=1)]) if live else np.zeros(0)
    values = np.concatenate([some[:live], np.zeros(len(some) - live)])
    return Fit(n, sums, values / n, float((r * r).sum() / n), vectors * sign[:, None])


def sound_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, dim, x): rows whose vector is not NULL nor empty and holds finite numbers only, as whole numbers floor(64 c) + 1000000.

    Entries beyond 2^55, whose whole number has no exact place in a long, are taken for non-finite.
    """
    c = F.col("embedding").cast("array<double>")
    sound = (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float(1 << 55))))
    # NULL where unsound: the optimizer may ask for a row's numbers before it is filtered
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, c).alias("c")).filter("c IS NOT NULL")
    return rows.select("vec_id", F.size("c").alias("dim"), F.transform("c", lambda e: F.floor(e * SCALE).cast("long") + OFFSET).alias("x"))


def column_sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{dim: (n, exact sums)}; one number a dimension comes to the driver."""
    sums = rows.select("dim", F.posexplode("x").alias("pos", "x")).groupBy("dim", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(sums.collect(), key=lambda r: (r.dim, r.pos)):
        out.setdefault(r.dim, (r.n, []))[1].append(int(r.s))
    return out


def exact_centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in 64-bit numbers where these hold it, else in Python's."""
    # every dimension's extreme over the whole table may lie in another batch, but only this batch is computed
    if max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums))) < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dim, rows, matrix) for every vector length in slices of a batch, whose column ``at`` holds the vectors."""
    for part in small_batches(iter([batch]), at, 8 << 20):
        sizes = np.diff(part.column(at).offsets.to_numpy())
        for dim in np.unique(sizes):
            some = part if (sizes == dim).all() else part.filter(pa.array(sizes == dim))
            yield int(dim), some, some.column(at).flatten().to_numpy(zero_copy_only=False).reshape(len(some), int(dim))


def _triangles(batches: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Fold blocks of rows into one triangle per vector length; returns its rows."""
    held: dict[int, np.ndarray] = {}
    for dim, block in batches:
        tall = np.concatenate([held[dim], block]) if dim in held else block
        held[dim] = np.linalg.qr(tall, mode="r")
    for dim, r in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim] * len(r), pa.int32()), pa.array(list(r), pa.list_(pa.float64()))], ["dim", "r"])


def triangle(rows: DataFrame, sums: dict[int, tuple[int, list[int]]], *, fan_in: int = FAN_IN) -> dict[int, np.ndarray]:
    """{dim: R} with R'R = the centred rows' products. A round folds ``fan_in`` triangles per task, until one task has all that is left."""

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _triangles((dim, (exact_centred(x, *sums[dim]) / sums[dim][0]).astype(float)) for batch in batches for dim, _, x in by_length(batch, 0))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _triangles((dim, x) for batch in batches for dim, _, x in by_length(batch, 1))

    schema = "dim int, r array<double>"
    now = settle(rows.select("x").mapInArrow(centred, schema), "triangles")
    whole = sum(sums)  # rows of one triangle of every length
    while True:
        parts = -(-now.count() // (fan_in * whole)) if whole else 1
        now = settle(now.repartition(max(parts, 1)).mapInArrow(folded, schema), "triangles")
        if parts <= 1:
            break
    out: dict[int, list] = {}
    for dim, r in now.collect():  # dimension x dimension
        out.setdefault(dim, []).append(r)
    return {dim: np.linalg.qr(np.concatenate([np.array(r, float), np.zeros((dim, dim))]), mode="r") for dim, r in out.items()}


def fit_whitening(rows: DataFrame, *, components: int = MOST_COMPONENTS) -> dict[int, Fit]:
    """One fit per vector length; the driver holds dimension x dimension numbers of each."""
    sums = column_sums(rows)
    return {dim: solve(r, *sums[dim], components) for dim, r in triangle(rows, sums).items()}


def _whitened(fit: Fit, x: np.ndarray) -> np.ndarray:
    """Rows by components; a component without variance has no value (NaN)."""
    live = len(fit.vectors)
    out = np.full((len(x), len(fit.values)), np.nan)
    out[:, :live] = (exact_centred(x, fit.n, fit.sums) / fit.n).astype(float) @ (fit.vectors.T / np.sqrt(fit.values[:live]))
    return out


def identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows.

    A task returns one matrix of components x components per vector length; a component without variance is left out.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in by_length(batch, 0):
                w = _whitened(fits[dim], x)[:, : len(fits[dim].vectors)]
                w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
                held[dim] = held.get(dim, 0.0) + w.T @ w
        for dim, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * m.size, pa.int32()), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], ["dim", "cell", "v"])

    cells = rows.select("x").mapInArrow(products, "dim int, cell int, v double").groupBy("dim", "cell").agg(F.sum("v").alias("v")).collect()
    out = {}
    for dim, fit in fits.items():
        k = len(fit.vectors)
        m = np.zeros((k + 1) ** 2)
        for r in cells:
            if r.dim == dim:
                m[r.cell] = r.v
        m = m.reshape(k + 1, k + 1) / fit.n
        cov = m[:k, :k] - np.outer(m[:k, k], m[:k, k])
        out[dim] = float(np.abs(cov - np.eye(k)).max(initial=0.0))
    return out


def whiten(embeddings: DataFrame, *, components: int = MOST_COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row per sound vector and component.

    The covariance is over all sound vectors of ``embeddings`` (vec_id, embedding). ``deviation`` is the exact sum of (n x - S)², NULL
    beyond a long. Vectors of unlike length are fitted apart. NULL or empty vectors and such with NULL or non-finite entries give
    no row; repeated rows count and return as often as they stand there; equal eigenvalues get some orthogonal directions, the
    same for all rows. A component without variance has NULL ``whitened`` (all of them with one row); ``explained`` is then 0.
    Where nothing varies at all ``explained`` is NULL. An empty table gives an empty table. Other columns are not looked at.
    """
    rows = sound_vectors(embeddings)
    fits = fit_whitening(rows, components=components)
    errors = identity_errors(rows, fits)
    shared = embeddings.sparkSession.sparkContext.broadcast((fits, errors))  # (components + 1) x dimension numbers a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, errors = shared.value
        for batch in batches:
            for dim, some, x in by_length(batch, 1):
                fit, k = fits[dim], len(fits[dim].values)
                apart = exact_centred(x, fit.n, fit.sums)
                if apart.dtype != object and float(np.abs(apart).max(initial=0)) ** 2 * dim >= float(1 << 62):
                    apart = apart.astype(object)
                deviation = [int(s) if s < 1 << 63 else None for s in (apart * apart).sum(axis=1)]
                w = _whitened(fit, x).ravel()
                explained = fit.values / fit.trace if fit.trace > 0 else np.full(k, np.nan)
                each = lambda column, kind: pa.array(column, kind).take(pa.array(np.repeat(np.arange(len(x)), k)))
                again = lambda values, kind: pa.array(np.tile(values, len(x)), kind, from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        each(some.column(0), pa.int64()), again(np.arange(1, k + 1), pa.int32()), again(np.array([fit.n]).repeat(k), pa.int64()),
                        each(deviation, pa.int64()), pa.array(w, pa.float64(), from_pandas=True), again(explained, pa.float64()),
                        again(np.full(k, errors[dim]), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.select("vec_id", "x").mapInArrow(run, schema)
