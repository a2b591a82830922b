"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Vectors become whole numbers x = floor(64 * c) + 1000000, so that counts, sums and the scatter of
the distinct vectors are exact: tasks multiply x less its rounded mean, in limbs of 20 bits whose
float products are exact, and Spark adds the parts as decimals.  The driver holds the scatter
alone (d * d numbers).  With P' V P = L L', rotating L's columns until they are orthogonal gives
V's eigenvalues as their squared norms and its eigenvectors as the columns made unit.

Rows without a vector, or with a null or non-finite entry, are dropped, and so are vectors of
another length than most rows have (of lengths as frequent, the greater stays).  Equal rows count
once in the fit and each give their own result.  A fit without spread has no components, and an
empty table gives no rows.  Components of value 0 are left out.  A deviation that exceeds a long
is null.  Further columns stay out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cut

SCALE, SHIFT, TOP = 64, 1_000_000, 16
#: Bits of a limb, and rows whose limb products are added as floats: 2 * 19 + 12 bits stay under 53.
LIMB, ROWS = 20, 4096
#: Sums that a task hands on in one row.
CHUNK = 32
#: Against the largest variance, a pivot so small is rounding.
RANK_EPS = 1e-17


def whole_vector(vector: Column) -> Column:
    """Entries as whole numbers; null where the vector or an entry is null or not finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def limbs(y: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Parts of whole numbers with their shifts; they add up to y and are of LIMB bits with sign."""
    out, shift, half = [], 0, 1 << (LIMB - 1)
    y = y.astype(np.int64)
    while y.any():
        low = ((y + half) & ((1 << LIMB) - 1)) - half
        out.append((shift, low.astype(np.float64)))
        y = (y - low) >> LIMB
        shift += LIMB
    return out


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y' y as Python's whole numbers."""
    total = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), ROWS):
        parts = limbs(y[at : at + ROWS])
        for s, a in parts:
            for t, b in parts:
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << (s + t))
    return total


def summed(rows: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> list:
    """Sums over all rows of what `part` makes of a batch's matrix: `size` numbers, added by Spark, CHUNK of them a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(matrix(batch.column(0), d))
                total = own if total is None else total + own
        if total is not None:
            full = [*total, *[0] * (-size % CHUNK)]
            chunks = [full[k : k + CHUNK] for k in range(0, size, CHUNK)]
            values = pa.array(chunks, pa.list_(pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(chunks))), values], ["k", "v"])

    parts = rows.select("x").mapInArrow(run, f"k long, v array<{kind}>")
    sums = parts.groupBy("k").agg(*(F.sum(F.col("v")[i]).cast(kind) for i in range(CHUNK)))
    return [v for r in sorted(sums.collect()) for v in r[1:]][:size]


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L', its rows in v's order, its columns as many as v's rank."""
    rest, columns = v.copy(), []
    least = RANK_EPS * max(np.diag(v).max(initial=0), 0)
    for _ in range(len(v)):
        p = int(np.argmax(np.diag(rest)))
        if rest[p, p] <= least:
            break
        column = rest[:, p] / np.sqrt(rest[p, p])
        columns.append(column)
        rest = rest - np.outer(column, column)
        rest[p, :] = rest[:, p] = 0
    return np.array(columns, v.dtype).T.reshape(len(v), len(columns))


def one_sided_jacobi(factor: np.ndarray, eps: float = 1e-18, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated in pairs until all are orthogonal."""
    columns = [c.copy() for c in factor.T]
    for _ in range(sweeps):
        turned = False
        for p in range(len(columns) - 1):
            for q in range(p + 1, len(columns)):
                a, b = columns[p], columns[q]
                aa, bb, ab = a @ a, b @ b, a @ b
                if abs(ab) <= eps * np.sqrt(aa * bb):
                    continue
                turned = True
                zeta = (bb - aa) / (2 * ab)
                t = (1 if zeta >= 0 else -1) / (abs(zeta) + np.sqrt(1 + zeta * zeta))
                c = 1 / np.sqrt(1 + t * t)
                columns[p], columns[q] = c * (a - t * b), c * (b + t * a)
        if not turned:
            break
    return np.array(columns, factor.dtype).T.reshape(factor.shape)


@dataclass
class Whitening:
    """n distinct vectors of d entries; x - S/n is x - mean - rest/n, with whole numbers mean and rest."""

    n: int
    mean: np.ndarray
    rest: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.mean) - np.array([r / self.n for r in self.rest])
        return centred @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        y = x - self.mean
        if ((float(np.abs(y).max(initial=0)) + 1) * self.n) ** 2 * max(1, x.shape[1]) < 2**62:
            z = y * self.n - np.array(self.rest, np.int64)
            return (z * z).sum(axis=1).tolist()
        sums = ((y.astype(object) * self.n - np.array(self.rest, object)) ** 2).sum(axis=1)
        return [int(s) if s < 1 << 63 else None for s in sums]


def whole_rows(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, x) of rows with whole vectors of the usual length, and that length (0 without any row)."""
    found = rows.select(F.col(id_col).alias("id"), whole_vector(F.col(vector_col)).alias("x")).filter("x is not null and size(x) > 0")
    usual = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = usual.d if usual else 0
    return found.filter(F.size("x") == d), d


def fit(rows: DataFrame, d: int, top: int = TOP) -> Whitening | None:
    """The components of the distinct vectors in column x; None without spread."""
    once = cut(rows.select("x").distinct())
    sums = summed(once, d, lambda x: np.array([len(x), *x.astype(object).sum(axis=0)], object), d + 1, "decimal(38,0)") if d else []
    if not sums:
        return None
    n, s = int(sums[0]), [int(v) for v in sums[1:]]
    mean = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)
    rest = [v - n * int(m) for v, m in zip(s, mean, strict=True)]
    upper = np.triu_indices(d)
    gram = summed(once, d, lambda x: exact_gram(x - mean)[upper], len(upper[0]), "decimal(38,0)")
    v = np.zeros((d, d), np.longdouble)
    for i, j, g in zip(*upper, gram, strict=True):
        v[i, j] = v[j, i] = np.longdouble(str(n * int(g) - rest[i] * rest[j])) / np.longdouble(n) / np.longdouble(n)
    turned = one_sided_jacobi(pivoted_cholesky(v))
    values = (turned * turned).sum(axis=0)
    order = np.argsort(-values, kind="stable")[:top]
    if not len(order):
        return None
    components = turned[:, order] / np.sqrt(values[order])
    # of either sign: the entry of greatest size is positive
    components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(order))])
    found = Whitening(n, mean, rest, components.astype(float), values[order].astype(float), (values[order] / np.trace(v)).astype(float))
    k = len(order)
    pairs = np.triu_indices(k)

    def moments(x: np.ndarray) -> np.ndarray:
        z = found.whitened(x)
        return np.concatenate([z.sum(axis=0), (z.T @ z)[pairs]])

    seen = np.array(summed(once, d, moments, k + len(pairs[0]), "double")) / n
    cov = seen[k:] - (seen[:k][pairs[0]] * seen[:k][pairs[1]])
    found.identity_error = float(np.abs(cov - (pairs[0] == pairs[1])).max())
    return found


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error of each row and component."""
    rows, d = whole_rows(table, id_col, vector_col)
    model = fit(rows, d, top)
    kind = table.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return table.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            x = matrix(batch.column(1), d)
            each, many = np.repeat(np.arange(len(x)), k), len(x) * k
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(many, model.n)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(many, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
