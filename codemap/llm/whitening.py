"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The components are the right singular vectors of the centred matrix X of the distinct vectors (the fit list). The bidiagonalisation
X V = U B builds orthonormal V (vectors of d numbers, on the driver) and U (vectors of n numbers, in the tasks) one step at a time:

    p = X v_j - beta u_{j-1},  freed of u_1 .. u_{j-1},  alpha = |p|,  u_j = p / alpha        (distributed product X v)
    q = X'u_j - alpha v_j,     freed of v_1 .. v_j,      beta = |q|,   v_{j+1} = q / beta     (distributed product X'u)

with full reorthogonalisation on both sides. A vector u_j is a combination of the columns of X, u_j = X w_j, so a task makes its part of it
anew from its rows and the d x j matrix of the w (at most d x d, like V): no state of n numbers is kept between the passes, and a
lost executor's part is made again from the stored fit list. A pass returns sums of at most 2 d numbers.
The singular value decomposition of the small bidiagonal B gives deviations and components; steps end when the wanted ones have
converged or X has no further direction. A step whose beta vanishes restarts with a direction at right angles to V, as equal
eigenvalues need.

Centring is exact: entries are whole numbers x, and n x - S is computed in integers before the division by n.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codemap.llm.common import Scratch, map_batches

SCALE = 64
OFFSET = 1_000_000
#: Entries beyond this have no exact double, so their vectors count as non-finite ones.
LARGEST = 2 ** 53
CONVERGED = 1e-13
#: Eigenvalues of less than this share of the first are rounding, not directions.
NEGLIGIBLE = 1e-12


def usable(entries: Column) -> Column:
    """Whether an array of doubles is not null and not empty, and all its entries are finite and have an exact whole number."""
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE + OFFSET + 1 >= F.lit(float(LARGEST))))
    return entries.isNotNull() & (F.size(entries) > 0) & ~F.coalesce(bad, F.lit(True))


def whole_numbers(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<long>): floor(64 c) + 1000000 for the entries c of usable vectors of the most frequent dimension (of equals, the largest)."""
    source = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("c"))
    source = source.filter(usable(F.col("c")))
    sizes = source.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    x = F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    return source.filter(F.size("c") == (sizes[0]["d"] if sizes else 0)).select("id", x.alias("x"))


def matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    """A column of arrays of d longs as a matrix."""
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as longs where they suffice, else as Python's integers."""
    if not len(x):
        return np.empty(x.shape, np.int64)
    if n * int(np.abs(x).max()) < 2 ** 62 and max(map(abs, sums)) < 2 ** 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


class Fit:
    """The fit list of a table of vectors: its distinct x, their number, dimension and sums; the components, once found."""

    def __init__(self, vectors: DataFrame, scratch: Scratch):
        # a vector that very many rows share is one row of each task before the shuffle
        self.rows = scratch.keep(vectors.select("x").distinct(), "fit")
        found = self.rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
        self.n, self.d = found["n"], found["d"] or 0
        totals = self.rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
        self.sums = [int(r["s"]) for r in sorted(totals, key=lambda r: r["i"])]
        self.values, self.components, self.trace = np.empty(0), np.empty((self.d, 0)), 0.0

    def total(self, function: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all rows of ``function`` (centred rows, as doubles -> a vector of sums)."""
        n, d, sums = self.n, self.d, self.sums

        def run(batches):
            done = None
            for batch in batches:
                part = function(centred(matrix(batch, "x", d), n, sums).astype(float) / n)
                done = part if done is None else done + part
            if done is not None:
                yield pa.record_batch([pa.array(range(len(done)), pa.int32()), pa.array(done, pa.float64())], names=["i", "v"])

        parts = map_batches(self.rows, run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(parts, key=lambda r: r["i"])])

    def bidiagonalise(self, wanted: int, seed: int = 1) -> None:
        """Sets the ``wanted`` leading eigenvalues of the covariance (fewer, if its rank is smaller), their vectors and its trace."""
        d, rng = self.d, np.random.default_rng(seed)
        if self.n < 2:
            return
        self.trace = float(self.total(lambda y: (y * y).sum(keepdims=True).ravel())[0]) / self.n
        V, W, alphas, betas = np.empty((d, 0)), np.empty((d, 0)), [], []
        v, beta, scale = _unit(rng.standard_normal(d)), 0.0, np.sqrt(self.trace * self.n)
        while scale > 0:
            V = np.column_stack([V, v])
            # p = X z, z = v_j - beta w_{j-1}; freed of the earlier u until its products with them, sums over the rows, vanish
            z = v - beta * W[:, -1] if W.shape[1] else v
            for _ in range(3):
                sums = self.total(lambda y, w=W, z=z: _products(y, w, y @ z))
                size, overlap = sums[d], sums[d + 1:]
                if np.linalg.norm(overlap) <= 1e-12 * np.sqrt(size):
                    break
                z = z - W @ overlap
            alpha = float(np.sqrt(size))
            alphas.append(alpha)
            if alpha <= 1e-14 * scale:
                alphas[-1], w, q = 0.0, np.zeros(d), np.zeros(d)
            else:
                w, q = z / alpha, sums[:d] / alpha - alpha * v
            W = np.column_stack([W, w])
            for _ in range(2):
                q = q - V @ (V.T @ q)
            beta = float(np.linalg.norm(q))
            left, values, right = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
            if V.shape[1] == d or V.shape[1] >= wanted and beta > 1e-14 * scale and np.all(beta * np.abs(left[-1, :wanted]) <= CONVERGED * values[0]):
                break
            if beta <= 1e-14 * scale and (scale ** 2 - np.sum(np.square(alphas)) - np.sum(np.square(betas))) <= NEGLIGIBLE * values[0] ** 2:
                break
            if beta <= 1e-14 * scale:  # the vectors found span all that X makes of them: go on at right angles
                beta, q = 0.0, rng.standard_normal(d)
                for _ in range(2):
                    q = q - V @ (V.T @ q)
            betas.append(beta)
            v = _unit(q)
        if scale > 0:
            keep = values[:wanted] ** 2 > NEGLIGIBLE * values[0] ** 2
            self.values = values[:wanted][keep] ** 2 / self.n
            self.components = (V @ right.T)[:, :wanted][:, keep]

    def identity_error(self) -> float | None:
        """The largest absolute entry of the covariance of the whitened fit list less the identity; null without a component."""
        k = len(self.values)
        if not k:
            return None
        map_to = self.components / np.sqrt(self.values)
        got = self.total(lambda y, m=map_to: np.concatenate([((y @ m).T @ (y @ m)).ravel(), (y @ m).sum(axis=0)]))
        mean = got[k * k:] / self.n
        return float(np.abs(got[:k * k].reshape(k, k) / self.n - np.outer(mean, mean) - np.eye(k)).max())


def _products(y: np.ndarray, w: np.ndarray, p: np.ndarray) -> np.ndarray:
    """X'p, p'p and U'p of some rows y of X and their part of p, U being X w."""
    return np.concatenate([y.T @ p, [p @ p], (y @ w).T @ p])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v)


def whiten(table: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation decimal(38,0), whitened, explained, identity_error): a row for every usable row and component.

    Components count from 1 by falling eigenvalue; there are as many as wanted, as dimensions, or as the covariance has eigenvalues above 1e-12 of
    the first, whichever is least. So there is no row at all for fewer than two distinct vectors. Rows without a usable vector (null, empty, with null or non-finite
    entries, or entries of 2^53 / 64 and more) are left out, and those whose dimension is not the most frequent one. Repeated rows and rows
    with equal or null ids each get their rows; the fit list has a repeated vector once. Other columns of the table are not read.
    """
    scratch = Scratch(table.sparkSession, "whitening")
    vectors = scratch.keep(whole_numbers(table, id_col, vector_col), "vectors")
    fit = Fit(vectors, scratch)
    fit.bidiagonalise(min(components, fit.d))
    error, n, d, sums = fit.identity_error(), fit.n, fit.d, fit.sums
    map_to, explained = fit.components / np.sqrt(fit.values), (fit.values / fit.trace if fit.trace else fit.values)
    k = len(fit.values)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                exact = centred(matrix(part, "x", d), n, sums)
                small = exact.dtype == np.int64 and d * float(np.abs(exact).max(initial=0)) ** 2 < 2.0 ** 62
                deviation = (exact * exact if small else exact.astype(object) ** 2).sum(axis=1)
                white = (exact.astype(float) / n) @ map_to
                each = np.repeat(np.arange(len(exact)), k)
                yield pa.record_batch([part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(exact)), pa.int32()), pa.array(np.full(len(each), n), pa.int64()),
                                       pa.array([str(v) for v in deviation.tolist()], pa.string()).take(pa.array(each)), pa.array(white.ravel(), pa.float64()),
                                       pa.array(np.tile(explained, len(exact)), pa.float64()), pa.array(np.full(len(each), error or 0.0), pa.float64())],
                                      names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = "id long, component int, n long, deviation string, whitened double, explained double, identity_error double"
    done = map_batches(vectors if k else vectors.limit(0), run, schema)
    return done.select(F.col("id").alias(id_col), "component", "n", F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"), "whitened", "explained", "identity_error")
