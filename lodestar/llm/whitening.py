"""Whitened embeddings from an exact integer scatter.

Every entry c becomes the whole number x = floor(1024 c) + 100000.  A scatter
does not change when a constant is subtracted, so tasks shift x back, add up
sums and cross-products without any rounding (slices of 21 bits are multiplied
as doubles in blocks small enough to stay exact, then added as Python
integers) and hand on one row per matrix entry.  The driver receives the
d (d + 3) / 2 + 1 totals of a d-dimensional table, however long it is, forms
n XtX - S St in integers, and only then divides once, correctly rounded, and
decomposes by ``eigh``.

Defined results: rows whose vector is null, empty or holds a null, NaN or
infinite entry go, as do vectors whose length is not the table's (the commonest
one, the longer on a tie); x beyond a long takes the long's end; a null vec_id stays null; repeated rows
count and come back each on their own; on equal eigenvalues any orthonormal
basis; each component's largest entry is positive.  A component without
variance has explained 0 (null if nothing varies) and null ``whitened``, and
the identity error leaves it out.  ``deviation`` is null where the exact value
(text in ``deviation_exact``) is beyond a long.  An empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestar.llm.scratch import stored

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Bits of a slice of an entry: products of two slices of 512 rows add up to less than 2**53.
SLICE = 21
#: A total travels as this many signed longs of 30 bits each, so Spark may add up 2**33 of them.
DIGITS, DIGIT_BITS = 6, 30
TOTALS = "i int, j int, " + ", ".join(f"d{k} long" for k in range(DIGITS))
LARGEST = float(2**52)


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, entries) of the vectors of ``dim`` finite entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    entries = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    whole = np.isfinite(entries).all(axis=1)
    return rows[whole], entries[whole]


def shifted(entries: np.ndarray) -> np.ndarray:
    """x - OFFSET, so that x stays inside a long."""
    scaled = np.floor(entries * SCALE)
    out = np.clip(scaled, -(2.0**63), 2.0**62).astype(np.int64)
    out[scaled > 2.0**62] = np.minimum(scaled[scaled > 2.0**62], np.nextafter(2.0**63, 0)).astype(np.int64)
    out[scaled >= 2.0**63 - OFFSET] = 2**63 - 1 - OFFSET
    return out


class Scatter:
    """Exact n, sums and cross-products of integer rows."""

    def __init__(self, dim: int) -> None:
        self.n, self.sums, self.cross = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)

    def add(self, y: np.ndarray) -> None:
        self.n += len(y)
        small = not len(y) or max(int(y.max()), -int(y.min())) < 1 << SLICE
        step = 1 << (53 - 2 * SLICE)
        for block in (y[a : a + step] for a in range(0, len(y), step)):
            # the last slice keeps the sign
            slices = [block] if small else [block & ((1 << SLICE) - 1), block >> SLICE & ((1 << SLICE) - 1), block >> 2 * SLICE]
            parts = [s.astype(np.float64) for s in slices]
            for a, left in enumerate(parts):
                self.sums += left.sum(axis=0).astype(np.int64).astype(object) << SLICE * a
                for b, right in enumerate(parts):
                    self.cross += (left.T @ right).astype(np.int64).astype(object) << SLICE * (a + b)

    def rows(self) -> Iterator[tuple]:
        """(i, j, digits): cross-products for i <= j, sums at i = -1, n at (-1, -1)."""
        yield -1, -1, *digits(self.n)
        for j, total in enumerate(self.sums):
            yield -1, j, *digits(total)
        for i in range(len(self.sums)):
            for j in range(i, len(self.sums)):
                yield i, j, *digits(self.cross[i, j])


def digits(value: int) -> tuple[int, ...]:
    low = tuple(int(value) >> DIGIT_BITS * k & ((1 << DIGIT_BITS) - 1) for k in range(DIGITS - 1))
    return *low, int(value) >> DIGIT_BITS * (DIGITS - 1)


@dataclass
class Whitening:
    """What a table's vectors were fitted to; ``sums`` are of x - OFFSET."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def alive(self) -> np.ndarray:
        return self.values > max(self.values[0], 0.0) * len(self.sums) * 2.0**-52


def vectors_of(df: DataFrame, vector: str) -> Column:
    kind = df.schema[vector].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType)
    return F.col(vector) if plain else F.col(vector).cast("array<double>")


def dimension(df: DataFrame, vector: str = "embedding") -> int | None:
    """The commonest length of the vectors that have entries."""
    lengths = df.groupBy(F.size(vector).alias("d")).count().filter("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return lengths[0]["d"] if lengths else None


def fitted(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The exact covariance's leading components; None for a table without usable vectors."""
    dim = dimension(df, vector)
    if dim is None:
        return None

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter = Scatter(dim)
        for batch in batches:
            scatter.add(shifted(usable(batch.column(0), dim)[1]))
        if scatter.n:
            columns = zip(*scatter.rows(), strict=True)
            kinds = [pa.int32()] * 2 + [pa.int64()] * DIGITS
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in TOTALS.split(", ")])

    parts = df.select(vectors_of(df, vector).alias("v")).mapInArrow(totals, TOTALS)
    met = parts.groupBy("i", "j").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS))).collect()
    total = {(r["i"], r["j"]): sum(r[f"d{k}"] << DIGIT_BITS * k for k in range(DIGITS)) for r in met}
    if not total:
        return None
    n, sums = total[-1, -1], [total[-1, j] for j in range(dim)]
    covariance = np.empty((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            covariance[i, j] = covariance[j, i] = (n * total[i, j] - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors.T[::-1][:components]
    heads = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
    return Whitening(n, sums, np.maximum(values, 0.0), vectors * np.sign(heads)[:, None], float(np.trace(covariance)))


def centred(y: np.ndarray, fit: Whitening) -> tuple[np.ndarray, list[int]]:
    """((x - S/n) as doubles, exact sums over dimensions of (n x - S)**2)."""
    if not len(y) or fit.n * float(np.abs(y).max()) + max(map(abs, fit.sums)) < LARGEST:
        z = fit.n * y - np.array(fit.sums, dtype=np.int64)
        high, low = z >> 26, z & ((1 << 26) - 1)
        if len(fit.sums) <= 1 << 10:
            squares = [(a << 52) + (b << 27) + c for a, b, c in zip((high * high).sum(axis=1).tolist(), (high * low).sum(axis=1).tolist(), (low * low).sum(axis=1).tolist(), strict=True)]
        else:
            squares = (z.astype(object) ** 2).sum(axis=1).tolist()
        return z / fit.n, squares
    z = y.astype(object) * fit.n - np.array(fit.sums, dtype=object)
    return (z / fit.n).astype(np.float64), (z * z).sum(axis=1).tolist()


def whiten(df: DataFrame, fit: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, deviation, deviation_exact, whitened array) of every usable row."""
    dim, kind = len(fit.sums), df.schema[vec_id].dataType
    scale = np.where(fit.alive, np.sqrt(fit.values), np.nan)
    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("deviation", T.LongType()), T.StructField("deviation_exact", T.StringType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, entries = usable(batch.column(1), dim)
            middle, squares = centred(shifted(entries), fit)
            # einsum adds each row up in one order, whatever batch it is in
            out = np.einsum("nd,kd->nk", middle, fit.vectors) / scale
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel(), from_pandas=True), out.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()), pa.array(map(str, squares), pa.string()), lists],
                names=schema.fieldNames(),
            )

    return df.select(vec_id, vectors_of(df, vector).alias("v")).mapInArrow(project, schema)


def identity_error(whitened: DataFrame, fit: Whitening) -> float | None:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity."""
    alive = np.flatnonzero(fit.alive).tolist()
    if not alive:
        return None
    at = {k: F.get("whitened", F.lit(k)) for k in alive}
    means = whitened.agg(*(F.avg(at[k]).alias(f"m{k}") for k in alive)).first()
    apart = {k: at[k] - F.lit(means[f"m{k}"]) for k in alive}
    pairs = [(a, b) for a in alive for b in alive if a <= b]
    products = whitened.agg(*(F.avg(apart[a] * apart[b]).alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(products[f"c{a}_{b}"] - float(a == b)) for a, b in pairs)


def whitening_table(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component."""
    kind = df.schema["vec_id"].dataType.simpleString()
    fit = fitted(df, components=components)
    if fit is None:
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string")
    held = stored(whiten(df, fit), "whitened")
    error = identity_error(held, fit)
    share = F.array(*(F.lit(float(v / fit.trace) if fit.trace > 0 else None).cast("double") for v in np.where(fit.alive, fit.values, 0.0)))
    return held.select("vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("place")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
        "deviation_exact",
    )
