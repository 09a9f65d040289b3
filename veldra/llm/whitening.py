"""Embedding whitening from an exact integer scatter.

Components become integers; every task subtracts a common shift and adds up n, the sums and the cross-products without
rounding; the totals give n * X'X - S S' exactly, and only that matrix is converted to floating point and decomposed.
Cross-products of a task are float matrix products of so few rows and so few bits that no product or sum rounds; wider
integers are cut into limbs. Totals travel as limbs of 32 bits in long columns, so Spark adds them up without overflow.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldra.llm.textcodes import bounded_batches
from veldra.storage import Scratch

#: x = floor(SCALE * c) + OFFSET of a component c. OFFSET is also the shift that is subtracted before products are added up.
SCALE, OFFSET = 1024, 100_000
#: Limbs of integers that don't fit a float product, and rows of a product.
LIMB_BITS, ROWS = 20, 1 << 12
#: Limbs of totals on their way.
WIRE_BITS = 32
#: Eigenvalues below this share of the largest count as 0.
LEAST_SHARE = 1e-13


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def integers(flat: np.ndarray, dims: int) -> np.ndarray:
    """Rows of x - OFFSET = floor(SCALE * c): int64, or Python integers where one doesn't fit."""
    scaled = np.floor(flat.reshape(-1, dims) * float(SCALE))
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([[int(v) for v in row] for row in scaled.tolist()], dtype=object).reshape(-1, dims)  # a product with a power of 2 is exact or infinite


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _limbs(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shift, float array) whose sum of ``limb << shift`` is ``x``; all limbs but the last are from 0 to 2^LIMB_BITS - 1."""
    out, shift = [], 0
    while _largest(x) >= 1 << LIMB_BITS:
        out.append((shift, (x & ((1 << LIMB_BITS) - 1)).astype(np.float64)))
        x, shift = x >> LIMB_BITS, shift + LIMB_BITS
    return [*out, (shift, x.astype(np.float64))]


def exact_gram(x: np.ndarray) -> np.ndarray:
    """x'x as Python integers."""
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for a in range(0, len(x), ROWS):  # ROWS * 2^(2 * LIMB_BITS) < 2^53: no sum rounds
        parts = _limbs(x[a : a + ROWS])
        for i, (s, u) in enumerate(parts):
            for t, v in parts[i:]:
                p = (u.T @ v).astype(np.int64).astype(object) << (s + t)
                total = total + (p if s == t else p + p.T)
    return total


def exact_squares(y: np.ndarray) -> list[int]:
    """Sum of squares of each row."""
    if y.dtype != object and _largest(y) ** 2 * y.shape[1] < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    y = y.astype(object)
    return (y * y).sum(axis=1).tolist()


@dataclass(frozen=True)
class Scatter:
    """Exact totals over the fit list: n, S = sums of x, and n * X'X - S S', all Python integers; the integers don't depend on the shift."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.sums)


@dataclass(frozen=True)
class Whitening:
    scatter: Scatter
    #: Columns are unit eigenvectors by falling eigenvalue.
    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if self.trace > 0 else np.zeros(len(self.eigenvalues))


def _flat(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))


def _totals(dims: int):
    upper = np.triu_indices(dims)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, gram = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
        for batch in batches:
            x = integers(_flat(batch.column(0)), dims)
            if len(x):
                n, gram = n + len(x), gram + exact_gram(x)
                narrow = x.dtype != object and _largest(x) * len(x) < 1 << 63
                sums = sums + (x.sum(axis=0).astype(object) if narrow else x.astype(object).sum(axis=0))
        if not n:
            return
        entries = [(-2, 0, n), *((-1, j, int(v)) for j, v in enumerate(sums)), *((int(i), int(j), int(v)) for i, j, v in zip(*upper, gram[upper], strict=True))]
        rows = []
        for i, j, v in entries:
            sign, v, k = (-1 if v < 0 else 1), abs(v), 0
            while v:
                rows.append((i, j, k, sign * (v & ((1 << WIRE_BITS) - 1))))
                v, k = v >> WIRE_BITS, k + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "limb", "value"])

    return run


def dimensions(df: DataFrame, vector: str) -> int:
    """The most frequent length of usable vectors, the greater one of equals; 0 without any."""
    sizes = df.where(usable(F.col(vector))).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return sizes["d"] if sizes else 0


def scatter(df: DataFrame, vector: str, dims: int) -> Scatter:
    """Exact totals over the usable vectors of ``dims`` components. The driver gets numbers of the order of dims squared."""
    bounded_batches(df.sparkSession)
    fit = df.where(usable(F.col(vector)) & (F.size(vector) == dims)).select(vector)
    got = fit.mapInArrow(_totals(dims), "i int, j int, limb int, value long").groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect()
    n, sums, gram = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
    for i, j, limb, value in got:
        v = int(value) << (WIRE_BITS * limb)
        if i == -2:
            n += v
        elif i == -1:
            sums[j] += v
        else:
            gram[i, j] += v
            if i != j:
                gram[j, i] += v
    return Scatter(n, sums + n * OFFSET, n * gram - np.outer(sums, sums))


def decompose(total: Scatter, components: int) -> Whitening:
    """Unit eigenvectors of the covariance scatter / n^2, numbered by falling eigenvalue, at most ``components`` of them."""
    d = total.dims
    v = np.array([[float(x) if abs(x) < 1 << 1000 else float("inf") for x in row] for row in total.scatter], float).reshape(d, d)
    if d and not np.isfinite(v).all():
        raise OverflowError("the covariance of these vectors exceeds floating point")
    v = v / max(total.n, 1) / max(total.n, 1)
    e, u = np.linalg.eigh(v)
    at = np.argsort(-e, kind="stable")[:components]
    return Whitening(total, u[:, at], np.maximum(e[at], 0.0), float(np.trace(v)))


def _projected(model: Whitening, dims: int):
    n, sums = model.scatter.n, model.scatter.sums - model.scatter.n * OFFSET
    e = model.eigenvalues
    alive = e > LEAST_SHARE * (e.max() if len(e) else 0.0)
    scale = np.where(alive, 1.0 / np.sqrt(np.where(alive, e, 1.0)), 0.0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow = [int(s) for s in sums]
        for batch in batches:
            x = integers(_flat(batch.column(1)), dims)
            if not len(x):
                continue
            fits = x.dtype != object and n * max(_largest(x), 1) + max(map(abs, narrow), default=0) < 1 << 62
            y = n * x - np.array(narrow, np.int64) if fits else n * x.astype(object) - sums  # n * x - S, exact
            centred = y.astype(np.float64) / n if fits else np.array([[float(v / Decimal(n)) if abs(v) >= 1 << 1000 else v / n for v in row] for row in y], float)
            w = (centred @ model.vectors) * scale
            flat = pa.array(w.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(v) for v in exact_squares(y)], pa.string()), lists], ["key", "deviation", "whitened"])

    return run


def whitened(df: DataFrame, vector: str, keep: list[str], model: Whitening) -> DataFrame:
    """``keep`` columns, deviation (exact decimal text: the sum of (n * x - S)^2) and ``whitened``: an array by component.

    A component whose eigenvalue is 0 is 0 for all rows. Rows whose vector isn't usable or has another length are left
    out; repeated rows each return; an empty table gives an empty one.
    """
    dims = model.scatter.dims
    key = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("key")
    rows = df.where(usable(F.col(vector)) & (F.size(vector) == dims)).select(key, vector)
    schema = T.StructType([rows.schema["key"], *T._parse_datatype_string("deviation string, whitened array<double>").fields])
    return rows.mapInArrow(_projected(model, dims), schema).select("key.*", "deviation", "whitened")


def identity_error(white: DataFrame, model: Whitening, column: str = "whitened") -> float:
    """Largest absolute entry of the whitened values' covariance less the identity, over components that vary; 0 without any."""
    e = model.eigenvalues
    alive = np.flatnonzero(e > LEAST_SHARE * (e.max() if len(e) else 0.0)).tolist()
    if not alive or not model.scatter.n:
        return 0.0
    w = lambda i: F.get(column, F.lit(i))
    pairs = [(i, j) for i in alive for j in alive if i <= j]
    mean = white.agg(*(F.avg(w(i)).alias(f"m{i}") for i in alive)).first()
    centred = lambda i: w(i) - F.lit(float(mean[f"m{i}"]))
    cov = white.agg(*(F.avg(centred(i) * centred(j)).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def fit_transform(df: DataFrame, vector: str, keep: list[str], components: int) -> tuple[DataFrame, Whitening]:
    """Whitened rows, written once, and the model."""
    dims = dimensions(df, vector)
    model = decompose(scatter(df, vector, dims), components) if dims else Whitening(Scatter(0, np.zeros(0, object), np.zeros((0, 0), object)), np.zeros((0, 0)), np.zeros(0), 0.0)
    return Scratch(df.sparkSession, "whitening").keep(whitened(df, vector, keep, model), "rows"), model
