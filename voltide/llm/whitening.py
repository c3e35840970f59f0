"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers, so sums and products are exact and no order of tasks shows. A first pass counts and sums;
a second takes the vectors less their mean, rounded to whole numbers, and adds up products a block of rows at a time; what
rounding the mean left out is under half a unit and is put right in whole numbers, so the scatter is exact. The driver
holds only matrices of the dimension: with pivots V = P L L' P', and plane rotations J make the columns of L J
orthogonal, so their squared norms are the eigenvalues and the normalised columns, put back in order, the components.

Defined cases: rows whose vector is null, has null or non-finite entries, or entries beyond LARGEST, are left out;
vectors of another length than most (of equally many: the longer) are left out too, empty ones as well; a component
without variance (few rows, equal rows, dependent entries) has null `whitened`, and without any variance `explained` and
`identity_error` are null; a deviation beyond a long is null; null and repeated ids are rows of their own; equal
eigenvalues are numbered in any order; an empty table gives an empty result; further columns are ignored by the query and
kept by `Whitening.transform`.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Entries beyond this, in steps of 1 / SCALE, count as not finite: their squares would not fit a decimal sum.
LARGEST = 2.0**50
#: Whole numbers below this are exact as doubles, and sums of them in any order.
EXACT = 2**53


def usable(vector_col: str, dimension: int | None = None):
    """Whether a row's vector has numbers only, and as many as `dimension` says."""
    v = F.col(vector_col)
    fine = F.coalesce(F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < LARGEST), F.lit(False))), F.lit(False)) & (F.size(v) > 0)
    return fine if dimension is None else fine & (F.size(v) == dimension)


def _whole(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch as whole numbers, a row each."""
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return (np.floor(np.asarray(flat.cast(pa.float64())) * SCALE) + OFFSET).astype(np.int64).reshape(-1, d)


def _pieces(batches: Iterator[pa.RecordBatch], d: int, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            yield piece, _whole(piece.column("v"), d)


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _pieces(batches, d):
            yield pa.RecordBatch.from_pydict({"i": np.arange(d, dtype=np.int32), "n": np.full(d, len(x)), "s": x.sum(axis=0)})

    return run


def _products(d: int, mean: list[int]):
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), dtype=object)  # whole numbers of any size, added once a piece
        for _, x in _pieces(batches, d):
            y = x - np.array(mean)
            exact = int(np.abs(y).max(initial=0)) ** 2 * len(y) < EXACT
            y = y.astype(np.float64 if exact else object)
            total = total + (y.T @ y).astype(np.int64 if exact else object)
        cells = pa.array([Decimal(int(m)) for m in total[upper]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), cells], ["i", "j", "m"])

    return run


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (lower trapezoidal, a column for each step until no variance is left) and the order p of rows: v[p][:, p] = L L'."""
    d = len(v)
    v, p, factor = v.copy(), np.arange(d), np.zeros((d, d))
    least = np.finfo(float).eps * d * max(v.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        at = k + int(np.argmax(v.diagonal()[k:]))
        if v[at, at] <= least:
            return factor[:, :k], p
        for m in (v, v.T, factor):
            m[[k, at]] = m[[at, k]]
        p[[k, at]] = p[[at, k]]
        factor[k, k] = np.sqrt(v[k, k])
        factor[k + 1:, k] = v[k + 1:, k] / factor[k, k]
        v[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, p


def one_sided_jacobi(a: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """a J with orthogonal columns, by plane rotations. A round of a tournament rotates disjoint pairs at once."""
    a = a.copy()
    r = a.shape[1]
    seats = list(range(r + r % 2))  # an odd one sits out against a seat without a column
    for _ in range(sweeps):
        largest = 0.0
        for _ in range(len(seats) - 1):
            pairs = [(min(x), max(x)) for x in zip(seats[: len(seats) // 2], reversed(seats[len(seats) // 2:])) if max(x) < r]
            i, j = (np.array(x, dtype=int) for x in zip(*pairs)) if pairs else (np.zeros(0, int),) * 2
            u, w = a[:, i], a[:, j]
            uu, ww, uw = (u * u).sum(axis=0), (w * w).sum(axis=0), (u * w).sum(axis=0)
            off = np.abs(uw) / np.sqrt(np.maximum(uu * ww, np.finfo(float).tiny))
            largest = max(largest, off.max(initial=0.0))
            turn = off > np.finfo(float).eps / 4
            zeta = (ww - uu) / np.where(turn, 2 * uw, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
            s = np.where(turn, c * t, 0.0)
            a[:, i], a[:, j] = c * u - s * w, s * u + c * w
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if largest <= 4 * np.finfo(float).eps:
            break
    return a


class Whitening:
    """n, sums and dimension of the vectors, the eigenvalues of their covariance by falling size, and its components."""

    def __init__(self, n: int, sums: list[int], scatter: list[list[int]]):
        """scatter: exact sums of products of x - S / n, times n; all in whole numbers."""
        self.n, self.sums, self.d = n, sums, len(sums)
        # a whole number over a whole number is the nearest double
        v = np.array([[cell / (n * n) for cell in row] for row in scatter], dtype=float).reshape(self.d, self.d)
        factor, order = pivoted_cholesky(v)
        turned = one_sided_jacobi(factor)
        norms = np.sqrt((turned * turned).sum(axis=0))
        fall = np.argsort(-norms, kind="stable")
        self.trace = sum(scatter[i][i] for i in range(self.d)) / (n * n) if n else 0.0
        self.eigenvalues = norms[fall] ** 2
        self.components = np.zeros((self.d, len(fall)))
        self.components[order] = turned[:, fall] / norms[fall]
        if len(fall):  # either sign would do: the largest entry is above zero, on every run
            top = np.abs(self.components).argmax(axis=0)
            self.components *= np.sign(self.components[top, np.arange(len(fall))])

    @classmethod
    def fit(cls, df: DataFrame, vector_col: str = "embedding") -> Whitening:
        lengths = df.where(usable(vector_col)).groupBy(F.size(vector_col).alias("d")).count()
        most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
        d = most["d"] if most else 0
        if not d:
            return cls(0, [], [])
        rows = df.where(usable(vector_col, d)).select(F.col(vector_col).cast("array<double>").alias("v"))
        by = rows.mapInArrow(_sums(d), "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        by = sorted(by.collect())  # a row a dimension
        n, sums = by[0]["n"], [int(r["s"]) for r in by]
        mean = [(2 * s + n) // (2 * n) for s in sums]
        found = rows.mapInArrow(_products(d, mean), "i int, j int, m decimal(38,0)").groupBy("i", "j").agg(F.sum("m").alias("m")).collect()
        left = [s - n * m for s, m in zip(sums, mean)]
        scatter = [[0] * d for _ in range(d)]
        for i, j, m in found:  # a row a pair of dimensions
            scatter[i][j] = scatter[j][i] = n * int(m) - left[i] * left[j]
        return cls(n, sums, scatter)

    def weights(self, components: int) -> np.ndarray:
        """A column a component: what a centred vector is multiplied by; none for components without variance."""
        return (self.components / np.sqrt(self.eigenvalues))[:, :components]

    def _numbers(self, components: int):
        n, sums, d = self.n, self.sums, self.d
        mean, weights = [(2 * s + n) // (2 * n) for s in sums] if n else [], self.weights(components)
        rest = np.array([(s - n * m) / n for s, m in zip(sums, mean)])  # of the mean, under half a unit

        def deviations(x: np.ndarray) -> list[int | None]:
            if (int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)) ** 2 * d < 2**63:
                y = n * x - np.array(sums)
                return (y * y).sum(axis=1).tolist()
            wide = n * x.astype(object) - np.array(sums, dtype=object)
            return [y if y < 2**63 else None for y in (wide * wide).sum(axis=1)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece, x in _pieces(batches, d):
                z = ((x - np.array(mean)).astype(np.float64) - rest) @ weights
                z = np.hstack([z, np.full((len(z), min(components, d) - z.shape[1]), np.nan)])
                flat = pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel()))
                lists = pa.FixedSizeListArray.from_arrays(flat, z.shape[1]).cast(pa.list_(pa.float64()))
                kept = [piece.column(k) for k in range(piece.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(deviations(x), pa.int64()), lists], [*piece.schema.names[:-1], "deviation", "whitened"])

        return run

    def transform(self, df: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> DataFrame:
        """The usable rows of `df` with all their columns, `deviation` and `whitened`, an array of a number a component."""
        own = [F.col(c).alias(f"__own_{c}") for c in df.columns]  # so that no name of theirs is in the way
        rows = df.where(usable(vector_col, self.d)).select(*own, F.col(vector_col).cast("array<double>").alias("v"))
        schema = T.StructType([*rows.schema.fields[:-1], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
        names = {c: c if c.lower() not in ("deviation", "whitened") else f"{c}_before" for c in df.columns}
        return rows.mapInArrow(self._numbers(components), schema).select(*[F.col(f"__own_{c}").alias(n) for c, n in names.items()], "deviation", "whitened")

    def explained(self, components: int) -> list[float | None]:
        """The share of each component in the trace of the covariance."""
        count = min(components, self.d)
        if not self.trace:
            return [None] * count
        return [float(e / self.trace) for e in self.eigenvalues[:count]] + [0.0] * (count - len(self.eigenvalues))


def identity_error(whitened: DataFrame, components: int, column: str = "whitened") -> float | None:
    """The largest absolute entry of the covariance of whitened rows minus the identity, in one aggregation."""
    at = lambda k: F.get(column, F.lit(k))
    if not components:
        return None
    cells = [F.max(F.lit(0.0)).alias("_")] + [F.abs(F.covar_pop(at(i), at(j)) - float(i == j)).alias(f"c{i}_{j}") for i in range(components) for j in range(i, components)]
    return max((c for c in whitened.agg(*cells).first() if c is not None), default=None)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = Whitening.fit(df)
    rows = model.transform(df, COMPONENTS).drop("embedding") if model.d else df.where("false").select("vec_id", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    rows = written(rows, "whitened")
    error = identity_error(rows, min(COMPONENTS, len(model.eigenvalues)))
    share = F.array(*[F.lit(e).cast("double") for e in model.explained(COMPONENTS)]) if model.d else F.array().cast("array<double>")
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
