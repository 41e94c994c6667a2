"""Embeddings on their principal components, scaled to unit variance.

Entries become whole numbers first, so each distinct vector and every sum is
exact. The components come by Chebyshev-filtered subspace iteration (Zhou, Saad,
Tiago and Chelikowsky, 2006): a block of orthonormal vectors goes through a
polynomial of the covariance that is small on the unwanted end of the spectrum,
is made orthonormal again and rotated by Rayleigh-Ritz, until the residuals of all
wanted components are at the level of rounding. The covariance itself is never
formed: each step of the recurrence is one pass over the distinct vectors, in
which tasks centre their blocks and add up ``X' (X Q)``; Spark sums what tasks
give, ``dim * block`` numbers. What the driver holds is of that size too, whatever
the number of vectors.

The distinct vectors lie in the shared folder as blocks of bytes, in the smallest
integers that hold them, and are read again in every pass, so a lost executor costs
its running tasks only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize

#: Entries become ``floor(SCALE * c) + SHIFT``.
SCALE, SHIFT = 64.0, 1_000_000
#: Whole numbers stay within this; a larger entry counts as the bound.
BOUND = 1 << 60
#: Most bytes of doubles that a task makes of vectors at a time.
BLOCK = 4 << 20
_WIDTHS = ("i1", "i2", "i4", "i8")


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """``floor(64 c) + 1000000`` of doubles, as int64."""
    return np.clip(np.floor(values * SCALE), -float(BOUND), float(BOUND)).astype(np.int64) + SHIFT


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a list column as doubles, null ones as NaN, and the place of the vector that each is in."""
    return pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False), pc.list_parent_indices(column).to_numpy(zero_copy_only=False)


def whole_lengths(column: pa.Array) -> np.ndarray:
    """Lengths of the vectors of an Arrow list column, -1 where one is null or holds null or non-finite entries."""
    out = np.array(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False), dtype=np.int64)
    values, parents = _values(column)
    out[parents[~np.isfinite(values)]] = -1
    return out


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the whole, finite vectors of length ``dim``, and those vectors as doubles."""
    there = whole_lengths(column) == dim
    values, parents = _values(column)
    return np.flatnonzero(there), values[there[parents]].reshape(int(there.sum()), dim)


def vector_length(vectors: DataFrame, column: str = "embedding") -> int:
    """The length that most usable vectors have, of several the greatest; 0 where there are none."""

    def run(batches):
        for batch in batches:
            lengths = whole_lengths(batch.column(0))
            dims, n = np.unique(lengths[lengths >= 0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"dim": pa.array(dims.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    counts = vectors.select(column).mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), F.desc("dim")).first()
    return found["dim"] if found else 0


def _pieces(batches, dim: int):
    """Batches of no more vectors than ``BLOCK`` allows."""
    rows = max(1, BLOCK // (8 * max(dim, 1)))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fit_list(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """``(width, rows, block, high, low)``: each distinct vector once, many to a block, with the block's sums.

    A block has its vectors less ``SHIFT`` as integers of ``width``; ``high`` and ``low`` are sums of
    the upper and lower 32 bits of their entries.
    """

    def packed(batches):
        for batch in _pieces(batches, dim):
            x = whole_numbers(usable(batch.column(0), dim)[1]).astype("<i8")
            yield pa.RecordBatch.from_pydict({"x": pa.array([row.tobytes() for row in x], pa.binary())})

    def blocks(batches):
        for batch in _pieces(batches, dim):
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<i8").reshape(batch.num_rows, dim)
            less = x - SHIFT
            width = next(w for w in _WIDTHS if np.iinfo(w).min <= less.min(initial=0) and less.max(initial=0) <= np.iinfo(w).max)
            yield pa.RecordBatch.from_pydict({
                "width": pa.array([width]), "rows": pa.array([len(x)], pa.int64()), "block": pa.array([less.astype(f"<{width}").tobytes()], pa.binary()),
                "high": pa.array([(x >> 32).sum(axis=0).tolist()], pa.list_(pa.int64())), "low": pa.array([(x & 0xFFFFFFFF).sum(axis=0).tolist()], pa.list_(pa.int64())),
            })

    # Equal vectors are made one in each task before they are exchanged.
    once = vectors.select(column).mapInArrow(packed, "x binary").groupBy("x").agg(F.count("*").alias("n")).select("x")
    return once.mapInArrow(blocks, "width string, rows long, block binary, high array<long>, low array<long>")


@dataclass(frozen=True)
class Sums:
    """How many distinct vectors there are, and the exact sums of their entries."""

    n: int
    total: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, modulo 2**64: right wherever it fits 64 bits."""
        # Whole arrays wrap silently, which is what is meant here.
        s = np.array([t & 0xFFFFFFFFFFFFFFFF for t in self.total], dtype=np.uint64).view(np.int64)
        return x * np.array([self.n], dtype=np.int64) - s

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``, each from an exact whole number where that fits 64 bits."""
        mean = np.array([t / self.n for t in self.total])
        rough = x - mean
        return np.where(np.abs(rough) * self.n < 2.0**62, self.deviations(x) / self.n, rough)

    def squared(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - S) ** 2``, exact; None where it doesn't fit a long."""
        rough = (((x - np.array([t / self.n for t in self.total])) * self.n) ** 2).sum(axis=1)
        d = self.deviations(x)
        exact = (d * d).sum(axis=1)
        near = np.flatnonzero(np.abs(rough - 2.0**63) < 2.0**43)  # too near the bound for the estimate
        true = {int(i): sum((self.n * int(v) - t) ** 2 for v, t in zip(x[i], self.total, strict=True)) for i in near}
        fits = [true[i] < 1 << 63 if i in true else rough[i] < 2.0**63 for i in range(len(x))]
        return [int(v) if ok else None for v, ok in zip(exact, fits, strict=True)]


def sums(blocks: DataFrame, dim: int) -> Sums:
    n = blocks.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    part = lambda c: F.sum(F.col(f"x.{c}").cast("decimal(38,0)"))
    rows = blocks.select(F.posexplode(F.arrays_zip("high", "low")).alias("i", "x")).groupBy("i").agg(part("high").alias("high"), part("low").alias("low")).collect()
    total = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in rows}
    return Sums(n, [total.get(i, 0) for i in range(dim)])


def _unpacked(width: str, block: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(block, dtype=f"<{width}").reshape(-1, dim).astype(np.int64) + SHIFT


class Covariance:
    """The covariance of the distinct vectors, as what it does to a block of columns."""

    def __init__(self, blocks: DataFrame, found: Sums, dim: int):
        self.blocks, self.sums, self.dim, self.passes = blocks.select("width", "block"), found, dim, 0

    def _added(self, size: int, of_block) -> np.ndarray:
        """Sum of ``of_block(centred vectors)``, an array of ``size`` numbers, over all blocks."""
        dim, found = self.dim, self.sums

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                for width, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    total += of_block(found.centred(_unpacked(width, block.as_py(), dim))).ravel()
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tolist()], pa.list_(pa.float64()))})

        parts = self.blocks.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("i", "x"))
        out = np.zeros(size)
        for i, x in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[i] = x
        self.passes += 1
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """``V q`` in one pass, each vector centred before it is multiplied."""
        return self._added(q.size, lambda x: x.T @ (x @ q)).reshape(q.shape) / self.sums.n

    def trace(self) -> float:
        return float(self._added(1, lambda x: (x * x).sum(keepdims=True))[0]) / self.sums.n

    def of_projected(self, p: np.ndarray) -> np.ndarray:
        """Covariance of the vectors' products with ``p``, the products' own mean taken out."""
        k = p.shape[1]
        got = self._added(k + k * k, lambda x: np.concatenate([(w := x @ p).sum(axis=0), (w.T @ w).ravel()])) / self.sums.n
        return got[k:].reshape(k, k) - np.outer(got[:k], got[:k])


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz on the orthonormal ``q``: falling values, rotated ``q`` and ``vq``."""
    t = q.T @ vq
    e, u = np.linalg.eigh((t + t.T) / 2)
    u = u[:, ::-1]
    return e[::-1], q @ u, vq @ u


def lower_end(times, start: np.ndarray, steps: int = 8) -> float:
    """About where the spectrum ends below: least Ritz value of a few Lanczos steps, less its residual, at least 0."""
    basis = [start / np.linalg.norm(start)]
    images = []
    for _ in range(min(steps, len(start) - 1)):
        images.append(times(basis[-1][:, None])[:, 0])
        have = np.stack(basis, axis=1)
        new = images[-1].copy()
        for _ in range(2):
            new -= have @ (have.T @ new)
        if np.linalg.norm(new) <= 1e-10 * np.linalg.norm(images[-1]):
            break
        basis.append(new / np.linalg.norm(new))
    e, q, vq = _ritz(np.stack(basis[: len(images)], axis=1), np.stack(images, axis=1))
    return max(0.0, float(e[-1] - np.linalg.norm(vq[:, -1] - e[-1] * q[:, -1])))


def components(times, dim: int, wanted: int, block: int | None = None, degree: int = 8, tol: float = 1e-15, rounds: int = 60, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues, falling, and unit eigenvectors of the operator ``times``.

    ``block`` columns are iterated, by default twice those wanted and 8. They are certified when each
    residual ``|V q - e q|`` is at most ``tol * sqrt(dim)`` of the greatest eigenvalue. If that can't
    be reached because rounding is above it, the best residuals must have been under 1e-11 of it.
    """
    k = min(dim, block or 2 * wanted + 8)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((dim, k)))[0]
    low = lower_end(times, q.sum(axis=1)) if k < dim else 0.0
    values, q, vq = _ritz(q, times(q))
    best, stale = None, 0
    for _ in range(rounds):
        scale = max(float(values[0]), 0.0)
        residual = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max())
        if best is None or residual < best[0]:
            stale = 0 if best is None or residual < best[0] / 2 else stale + 1
            best = residual, values[:wanted].copy(), q[:, :wanted].copy()
        else:
            stale += 1
        if residual <= tol * np.sqrt(dim) * scale or stale >= 2:
            break
        high = float(values[-1])
        if k == dim:
            y = q  # the whole space: nothing is left to damp
        elif high - low <= 1e-12 * scale or scale <= high:
            y = vq  # no interval to damp, as where the rank is below the block: a plain power step
        else:
            middle, half = (high + low) / 2, (high - low) / 2
            # The first component may outgrow the last one wanted only so far that both keep their digits.
            ahead = np.arccosh((scale - middle) / half) - np.arccosh(max((values[wanted - 1] - middle) / half, 1.0))
            times_on = degree if ahead * degree <= 16 else max(2, int(16 / ahead))
            # sigma scales each step so that the greatest eigenvalue's polynomial stays near 1.
            sigma = first = half / (scale - middle)
            y, old = (vq - middle * q) * (sigma / half), q
            for _ in range(2, times_on + 1):
                after = 1 / (2 / first - sigma)
                y, old = (times(y) - middle * y) * (2 * after / half) - (sigma * after) * old, y
                sigma = after
        q = np.linalg.qr(y)[0]
        values, q, vq = _ritz(q, times(q))
    if best[0] > 1e-11 * max(float(best[1][0]), 1e-300):
        raise RuntimeError(f"components did not settle: residual {best[0]:g} at the eigenvalue {best[1][0]:g}")
    return best[1], best[2]


def whiten(vectors: DataFrame, wanted: int = 16, key: str = "vec_id", column: str = "embedding", **options) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row for each usable vector and component.

    Vectors that are null or hold null or non-finite entries are dropped. Should lengths differ, those of
    the commonest length are taken (of several the greatest) and the others dropped; empty
    vectors have no components. Components without variance (below 1e-12 of the first) are left out, so vectors that are all alike,
    or a single one, give no rows, as an empty table does. Entries beyond 2**60 / 64 count as that; a deviation that
    no long holds is null. Repeated rows and rows without an id have their own rows each, and count once for the fit.
    Ties of eigenvalues give any basis of their space, the same for all rows. Other columns play no part.
    """
    spark = vectors.sparkSession
    kinds = f"{key} {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = vector_length(vectors, column)
    if not dim:
        return spark.createDataFrame([], kinds)
    blocks = materialize(fit_list(vectors, dim, column), "whitening-fit")
    found = sums(blocks, dim)
    v = Covariance(blocks, found, dim)
    trace = v.trace()
    if not trace > 0:
        return spark.createDataFrame([], kinds)
    e, q = components(v.times, dim, min(wanted, dim), **options)
    some = int((e > 1e-12 * e[0]).sum())
    e, q = e[:some], q[:, :some]
    scaled = q / np.sqrt(e)
    error = float(np.abs(v.of_projected(scaled) - np.eye(some)).max())
    explained = e / trace

    def run(batches):
        for batch in _pieces(batches, dim * some):
            at, values = usable(batch.column(1), dim)
            x = whole_numbers(values)
            w = found.centred(x) @ scaled
            many = len(at) * some
            yield pa.RecordBatch.from_pydict({
                key: batch.column(0).take(pa.array(np.repeat(at, some))), "component": pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), len(at))), "n": pa.array(np.full(many, found.n)),
                "deviation": pa.array([d for d in found.squared(x) for _ in range(some)], pa.int64()), "whitened": pa.array(w.ravel()),
                "explained": pa.array(np.tile(explained, len(at))), "identity_error": pa.array(np.full(many, error)),
            })

    return vectors.select(key, column).mapInArrow(run, kinds)
