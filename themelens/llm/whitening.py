"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers, x = floor(scale * c) + shift, so their sums are exact and a row centred on
the mean is (x - S // n) - (S % n) / n, without cancellation.  With X the centred rows, the
bidiagonalisation alternates u = Xv and w = Xᵀu: a step is one pass over the rows, in which every task
computes its part of u, and of w and of Uᵀu with it, and leaves one row of sums.

* The vectors v (of the rows' length) stay on the driver and are orthogonalised twice against all before.
* The vectors u (one entry a row of the table) are never stored: u_j = X p_j with a short vector p_j, so a
  task computes them anew from its rows.  A new u is orthogonalised against all before by the products
  Xᵀu_i that are known, and once more by the inner products that the pass measures.
* The singular values of the small bidiagonal matrix over sqrt(n) are the deviations, and its right
  singular vectors, in the basis of the v, the components.

It starts in the row space, goes on with a fresh vector, orthogonal to all before, where it breaks down
(equal deviations), and ends when the rows have no more dimensions or the residuals of all wanted
components are at rounding error.  Deviations of at most ``ZERO`` times the largest count as none: such
components can't be whitened and are not returned.

Defined results: rows whose vector is null, empty, holds null or non-finite entries or entries beyond 2**53
after scaling take no part, nor do vectors of another length than the most frequent one (ties: the longest).  Repeated rows and
null ids are rows like any other.  ``deviation`` is null if it exceeds a long.  Fewer components than
asked are returned if the vectors span fewer dimensions, none if all are equal; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, query, read

#: Deviations below this share of the largest are rounding errors.
ZERO = 1e-9
#: Residuals below this share of the largest deviation are rounding errors.
CONVERGED = 4 * np.finfo(float).eps
SEED = 11


def integers(rows: DataFrame, scale: float, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, without the rows that take no part."""
    entry = lambda c: F.lit(float(scale)) * c.cast("double")
    good = ~F.exists(F.col(vector_col), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(entry(c)) > float(1 << 53)))
    usable = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & good)
    return usable.select(F.col(id_col).alias("vec_id"),
                         F.transform(vector_col, lambda c: F.floor(entry(c)) + F.lit(shift).cast("long")).alias("x"))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Rows:
    """The vectors of one fit: their number, their exact sums and passes over them."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors
        size = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        self.d, self.n = (size.d, size.n) if size else (0, 0)
        if self.n:
            self.vectors = vectors.where(F.size("x") == self.d)
            sums = self.vectors.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
            total = {r.k: int(r.s) for r in sums.collect()}  # one row a dimension
            self.whole = np.array([total[k] // self.n for k in range(self.d)], dtype=np.int64)
            self.rest = np.array([total[k] % self.n for k in range(self.d)], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def summed(self, part, size: int) -> np.ndarray:
        """Sum over all rows of ``part(centred rows)``, ``size`` numbers."""
        centred = self.shared()

        def gather(batches):
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += part(centred(matrix(batch.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "s"])

        sums = self.vectors.select("x").mapInArrow(gather, "k long, s double").groupBy("k").agg(F.sum("s").alias("s"))
        out = np.zeros(size)
        for r in sums.collect():
            out[r.k] = r.s
        return out

    def shared(self):
        """The centring as a function of its own, free of the session."""
        whole, rest = self.whole, self.rest / self.n
        return lambda x: (x - whole) - rest


def orthogonal(v: np.ndarray, basis: list) -> np.ndarray:
    """``v`` without its part in ``basis``, taken off twice."""
    if basis:
        q = np.array(basis)
        for _ in range(2):
            v = v - q.T @ (q @ v)
    return v


def step(rows: Rows, p: np.ndarray, before: list) -> tuple[np.ndarray, np.ndarray, float]:
    """Xᵀu, Uᵀu and uᵀu of u = Xp, with U = X times ``before``."""
    d, all_p = rows.d, np.array([*before, p]).T

    def part(y):
        u = y @ all_p
        return np.concatenate([y.T @ u[:, -1], u.T @ u[:, -1]])

    sums = rows.summed(part, d + all_p.shape[1])
    return sums[:d], sums[d:-1], float(sums[-1])


def bidiagonalise(rows: Rows, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Deviations times sqrt(n), falling, and their components (one a row) of the centred ``rows``."""
    rng = np.random.default_rng(SEED)
    vs, ps, ws, diagonal, above = [], [], [], [], []
    largest, fresh, looked = 0.0, True, False
    v = rng.standard_normal(rows.d)
    while len(vs) < min(rows.d, rows.n):
        if fresh:  # a vector of the row space that is orthogonal to all before
            v = orthogonal(v, vs)
            v, _, size = step(rows, v / np.linalg.norm(v), [])
            v = orthogonal(v, vs)
            norm = np.linalg.norm(v)
            if size ** 0.5 <= ZERO * max(largest, np.sqrt(size)) or norm == 0:
                break
            v, coupling = v / norm, 0.0
        p = v
        for _ in range(2):  # off all u before: their products with Xv are known
            known = np.array(ws) @ p if ws else np.zeros(0)
            p = p - np.array(ps).T @ known if ps else p
        w, measured, size = step(rows, p, ps)
        if ps:
            p, w = p - np.array(ps).T @ measured, w - np.array(ws).T @ measured
            size -= float(measured @ measured)
        alpha = np.sqrt(max(size, 0.0))
        largest = max(largest, alpha, coupling)
        if alpha <= ZERO * largest:
            break
        vs.append(v)
        ps.append(p / alpha)
        ws.append(w / alpha)
        diagonal.append(alpha)
        above.append(coupling)
        left, values, right = small_svd(diagonal, above)
        v = orthogonal(ws[-1] - alpha * v, vs)
        beta = np.linalg.norm(v)
        if len(values) >= wanted and (beta * np.abs(left[-1, :wanted]) <= CONVERGED * values[0]).all():
            if looked:
                break  # stands, also after a fresh vector looked for what the first one could not reach
            looked, fresh, v = True, True, rng.standard_normal(rows.d)
            continue
        fresh = beta <= ZERO * largest
        v, coupling = (rng.standard_normal(rows.d), 0.0) if fresh else (v / beta, beta)
    if not vs:
        return np.zeros(0), np.zeros((0, rows.d))
    _, values, right = small_svd(diagonal, above)
    keep = values > ZERO * values[0]
    return values[keep][:wanted], (right[keep] @ np.array(vs))[:wanted]


def small_svd(diagonal: list, above: list):
    """Singular value decomposition of the bidiagonal matrix."""
    return np.linalg.svd(np.diag(diagonal) + np.diag(above[1:], 1))


def deviations(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> list:
    """Exact sum of (n * x - S) ** 2 of every row; null beyond a long."""
    y = x - whole
    if float(n) ** 2 * ((np.abs(y).astype(float) + 1) ** 2).sum(axis=1).max(initial=0) < 2.0 ** 62:
        return ((n * y - rest) ** 2).sum(axis=1).tolist()
    sums = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist())) for row in y.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


def whiten(rows: DataFrame, components: int = 32, scale: float = 64.0, shift: int = 1_000_000,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, one row a vector and component."""
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    columns = f"vec_id {kind}, deviation long, z array<double>"
    fit = Rows(materialise(integers(rows, scale, shift, id_col, vector_col), "integers"))
    values, vectors = bidiagonalise(fit, components) if fit.n else (np.zeros(0), np.zeros((0, 1)))
    if not len(values):
        empty = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                          "explained double, identity_error double")
        return empty
    n, k, whole, rest, centred = fit.n, len(values), fit.whole, fit.rest, fit.shared()
    scaled = vectors.T / values * np.sqrt(n)

    def moments(y):
        z = y @ scaled
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0), [(y * y).sum()]])

    sums = fit.summed(moments, k * k + k + 1)
    mean = sums[k * k:-1] / n
    error = float(np.abs(sums[:k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = (values ** 2 / sums[-1]).tolist()

    def project(batches):
        for batch in batches:
            x = matrix(batch.column(1)) if batch.num_rows else np.zeros((0, len(whole)), np.int64)
            z = centred(x) @ scaled
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviations(x, whole, rest, n), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, k, dtype=np.int32)), pa.array(z.ravel()))],
                names=["vec_id", "deviation", "z"])

    out = fit.vectors.mapInArrow(project, columns).select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    shares = F.array(*[F.lit(e) for e in explained])
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every row of ``embeddings``."""
    return whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
