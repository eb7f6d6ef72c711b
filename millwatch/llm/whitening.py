"""Embedding whitening from bit-sliced sums of cross-products.

Entries become integers, x = floor(256 c). The fit list holds each distinct x vector once. A task takes its vectors in
chunks; in a chunk each dimension is shifted to begin at 0, and bit b of all its rows is packed into 64-bit words, so the
cross-product of two dimensions is the sum, over pairs of their planes, of 2 ** (a + b) times the number of ones in the
AND of the planes. Shifts are taken out again in whole numbers. What leaves a task are sums, as three limbs of 48 bits
each, which Spark adds up: a row for each pair of dimensions, whatever the number of vectors. The driver centres
n * cross-products - sums * sums in whole numbers, divides once and takes eigenvectors (`eigh`); the whitened fit list is
measured again by Spark (`identity_error`).

Memory: a chunk has `ENTRIES` entries at most (64 rows at least); a lost task is run again, nothing is held elsewhere.

Defined results: null vectors, empty ones and vectors with a null or non-finite entry take no part, nor do vectors of
another length than the most frequent one (the longer, at a tie). Rows that repeat an id or a vector give their own
rows; a null id stays null. Entries beyond the range of long / 256 are held at its ends. Components whose eigenvalue is
0 in double precision (constant vectors, fewer distinct vectors than dimensions, one vector) have whitened null and
explained 0; identity_error leaves them out and is null if none is left. A deviation that exceeds a long is null there
and exact in deviation_exact (decimal(38,0), null beyond). Ties of eigenvalues take LAPACK's order. An empty table gives
an empty result. Output columns are fixed, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm.common import U64, written

SCALE = 256.0
#: Entries of a chunk, and rows at most.
ENTRIES, ROWS = 1 << 22, 1 << 15
LIMB = 48
COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, deviation_exact decimal(38,0)"


@dataclass
class Whitening:
    """n distinct vectors with sums per dimension; the first eigenvalues (falling) and unit eigenvectors (a column each)
    of their covariance, its trace, and the whitened fit list's distance from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None


def integer_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id long, x array<long>) of the rows that take part."""
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.where(F.size("v") > 0).where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    sizes = rows.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).limit(1).collect()  # one row
    return rows.where(F.size("v") == (sizes[0]["k"] if sizes else 0)).select("vec_id", F.transform("v", lambda c: F.floor(SCALE * c)).alias("x"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def bit_planes(u: np.ndarray, bits: int) -> np.ndarray:
    """(dimensions, bits, words): bit b of each dimension's rows, 64 rows a word."""
    rows, dims = u.shape
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words), dtype=U64)
    for b in range(bits):
        packed = np.zeros((words * 8, dims), dtype=np.uint8)
        packed[: -(-rows // 8)] = np.packbits(((u >> U64(b)) & U64(1)).astype(np.uint8), axis=0)
        out[:, b] = np.ascontiguousarray(packed.T).view(U64)
    return out


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of each dimension, sums of products of each pair of dimensions) as Python integers, exact."""
    rows, dims = x.shape
    low = x.min(axis=0)
    u = x.view(U64) - low.view(U64)  # modulo 2 ** 64, so right for any longs
    bits = max(1, int(u.max()).bit_length())
    planes = bit_planes(u, bits)
    kind = np.int64 if 2 * bits + rows.bit_length() < 63 else object
    weight = np.array([1 << b for b in range(bits)], dtype=kind)
    prod, total = np.zeros((dims, dims), dtype=object), np.zeros(dims, dtype=object)
    for i in range(dims):
        rest = planes[i:].reshape(-1, planes.shape[2])
        acc = np.zeros(dims - i, dtype=kind)
        for a in range(bits):
            ones = np.bitwise_count(rest & planes[i, a]).sum(axis=1, dtype=np.int64).reshape(-1, bits)
            acc = acc + (ones.astype(kind) * weight).sum(axis=1) * weight[a]
        prod[i, i:] = prod[i:, i] = acc
        total[i] = int((np.bitwise_count(planes[i]).sum(axis=1, dtype=np.int64).astype(object) * weight.astype(object)).sum())
    low = low.astype(object)
    return total + rows * low, prod + np.outer(low, total) + np.outer(total, low) + rows * np.outer(low, low)


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, limbs) of a task: products of i <= j, sums with j = -1, the number of vectors with i = j = -1."""
    held, rows, n, sums, prod = [], 0, 0, 0, 0

    def take():
        nonlocal held, rows, n, sums, prod
        if rows:
            s, p = cross_products(np.ascontiguousarray(np.concatenate(held)))
            n, sums, prod = n + rows, sums + s, prod + p
            held, rows = [], 0

    for batch in batches:
        x = _matrix(batch, "x")
        most = min(ROWS, max(64, ENTRIES // max(1, x.shape[1])))
        while len(x):
            part = x[: most - rows]
            held.append(part)
            rows += len(part)
            x = x[len(part) :]
            if rows == most:
                take()
    take()
    if n:
        i, j = np.triu_indices(len(sums))
        k = np.arange(len(sums))
        value = np.concatenate([prod[i, j], sums, np.array([n], dtype=object)])
        limbs = [value & ((1 << LIMB) - 1), (value >> LIMB) & ((1 << LIMB) - 1), value >> 2 * LIMB]
        ends = [np.concatenate([i, k, [-1]]), np.concatenate([j, np.full(len(k), -1), [-1]])]
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in ends), *(pa.array(c.astype(np.int64)) for c in limbs)], names=["i", "j", "a", "b", "c"])


def fit(x: DataFrame, most: int = 4) -> Whitening:
    """The whitening of integer_vectors() by their covariance, of `most` components at most."""
    # equal vectors meet after each task has kept one of its own
    once = written(x.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    found = once.mapInArrow(_scatter, "i int, j int, a long, b long, c long").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "abc"]).collect()  # a row a pair of dimensions
    if not found:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    value = {(r["i"], r["j"]): r["a"] + (r["b"] << LIMB) + (r["c"] << 2 * LIMB) for r in found}
    n, dims = value[-1, -1], max(i for i, _ in value) + 1
    sums = [value[i, -1] for i in range(dims)]
    centred = lambda i, j: n * value[min(i, j), max(i, j)] - sums[i] * sums[j]
    cov = np.array([[centred(i, j) / (n * n) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    values = np.where(values > dims * np.finfo(float).eps * max(values[0], 0.0), values, 0.0)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    model = Whitening(n, sums, values, vectors, sum(centred(i, i) for i in range(dims)) / (n * n))
    model.identity_error = _identity_error(once, model)
    return model


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """(n x - S) of each row, in int64 where that is safe, else as Python integers; and the whitened components."""
    big = model.n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(map(abs, model.sums)) if len(x) else 0
    kind = np.int64 if len(model.sums) * big * big < 1 << 63 else object
    off = x.astype(kind) * model.n - np.array(model.sums, dtype=kind)
    scale = np.where(model.values > 0, np.sqrt(np.where(model.values > 0, model.values, 1.0)), np.nan)
    return off, (off / model.n).astype(float) @ model.vectors / scale


def _identity_error(once: DataFrame, model: Whitening) -> float | None:
    names = [f"w{k}" for k in range(len(model.values)) if model.values[k] > 0]
    if not names:
        return None
    sent = once.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = project(_matrix(batch, "x"), sent.value)[1]
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(len(names))], names=names)

    w = once.mapInArrow(run, ", ".join(f"{c} double" for c in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return w.agg(F.greatest(*[F.abs(F.covar_pop(a, b) - (1.0 if a == b else 0.0)) for a, b in pairs], F.lit(0.0)).alias("e")).first()["e"]


def apply(x: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, deviation_exact, identity_error): a row for each of
    integer_vectors() and component."""
    sent = x.sparkSession.sparkContext.broadcast(model)
    explained = np.where(model.trace > 0, model.values / (model.trace or 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        many = len(m.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            off, w = project(_matrix(batch, "x"), m)
            far = (off * off).sum(axis=1).astype(object)
            long = pa.array([int(v) if v < 1 << 63 else None for v in far], pa.int64())
            wide = pa.array([Decimal(int(v)) if v < 10**38 else None for v in far], pa.decimal128(38, 0))
            at = np.repeat(np.arange(batch.num_rows), many)
            flat = w.ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(len(at), m.n)), long.take(pa.array(at)), pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(explained, batch.num_rows)), wide.take(pa.array(at))],
                names=[c.split()[0] for c in COLUMNS.replace("(38,0)", "").split(", ")],
            )

    return x.mapInArrow(run, COLUMNS).withColumn("identity_error", F.lit(model.identity_error).cast("double"))


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = 4) -> DataFrame:
    """Fits on df's distinct vectors and gives the components of all its rows that take part."""
    x = integer_vectors(df, vec_id, vector)
    return apply(x, fit(x, most))
