"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Entries become integers x = floor(64 c) + 1000000. The fit list is every
distinct x vector once. Two passes over it give exact integer sums: the count
and per-dimension sums S first, then the products of d = x - floor(S/n). So
n times the centred scatter, n * sum(d d') - R R' with R = S - n floor(S/n),
is exact whatever the order of tasks, and doubles begin at its division.

The scatter (its size is given by the vectors' length, not by the data) is
factored on the driver: Cholesky with diagonal pivoting gives a triangular
factor L, one-sided Jacobi rotates pairs of its columns until all are
orthogonal. The rotated columns' squared norms are the eigenvalues, the columns
scaled to length one the components; the scatter's eigenvectors are never
sought in the squared matrix again.

A third pass over the fit list measures the whitened values' covariance.

Edge cases: rows whose vector is null or holds a null or non-finite entry are
dropped; vectors of different length are fitted apart (n, components and errors
are those of the row's length); equal vectors count once in the fit and each
return rows; components beyond the numerical rank (no variance left) don't
exist, so one distinct vector or empty vectors give no rows; entries beyond
2^46 in size count as 2^46 of their sign; ``deviation`` is null where it
doesn't fit a long; a null or repeated vec_id is returned as it is; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadshape.llm.shared import bound_batches, write_shared

SCALE = 64
SHIFT = 1_000_000
MOST_ENTRY = 2.0 ** 46
COMPONENTS = 16
#: Integers up to here are exact in a double.
EXACT = 1 << 53
SWEEPS = 60


def scaled_rows(vectors: DataFrame) -> DataFrame:
    """Rows with a whole, finite vector of one entry or more, as integers:
    vec_id, dim, x."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf")))
    bounded = lambda c: F.greatest(F.least(c.cast("double"), F.lit(MOST_ENTRY)), F.lit(-MOST_ENTRY))
    return vectors.where(F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0)).select(
        "vec_id", F.size("embedding").alias("dim"),
        F.transform("embedding", lambda c: F.floor(bounded(c) * SCALE) + F.lit(SHIFT)).alias("x"))


def integers(frame: pd.DataFrame, dim: int) -> np.ndarray:
    return np.array(frame["x"].to_list(), np.int64).reshape(len(frame), dim)


def exact_products(d: np.ndarray) -> np.ndarray:
    """d' d of an integer matrix, exact: slices of rows whose sums stay exact
    in doubles, or Python integers where single products don't."""
    most = int(max(d.max(initial=0), -int(d.min(initial=0)))) or 1
    rows = EXACT // (most * most)
    if not rows:
        return d.astype(object).T @ d.astype(object)
    total = np.zeros((d.shape[1], d.shape[1]), object if len(d) * most * most >= 1 << 62 else np.int64)
    for at in range(0, len(d), rows):
        part = d[at: at + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64)
    return total


def partial_sums(rows: DataFrame, size: str, partial, name: str) -> DataFrame:
    """Sums per (dim, i, j) of what ``partial(dim, x)`` gives for each batch:
    a vector (j = 0) or a symmetric matrix (i <= j). Each task adds up its own
    batches first, one length of vector at a time."""

    def told(dim: int, total: np.ndarray) -> pd.DataFrame:
        i, j = (np.arange(len(total)), np.zeros(len(total), int)) if total.ndim == 1 else np.triu_indices(len(total))
        values = total if total.ndim == 1 else total[i, j]
        exact = [Decimal(int(v)) if isinstance(v, (int, np.integer)) else Decimal(f"{float(v):.15f}") for v in values]
        return pd.DataFrame({"dim": dim, "i": i, "j": j, "value": exact})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for frame in frames:
            for dim, part in frame.groupby("dim", sort=True):
                found = partial(int(dim), integers(part, int(dim)))
                if now == dim:
                    total = total + found
                else:
                    if total is not None:
                        yield told(now, total)
                    now, total = int(dim), found.astype(object) if found.dtype == np.int64 else found
        if total is not None:
            yield told(now, total)

    sums = rows.select("dim", "x").sortWithinPartitions("dim").mapInPandas(add, f"dim int, i int, j int, value {size}")
    return write_shared(sums.groupBy("dim", "i", "j").agg(F.sum("value").alias("value")), name)


def by_dim(sums: DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """The sums of each length of vector: its entries, or pairs of them."""
    ordered = sums.orderBy("dim", "i", "j").toLocalIterator()
    for dim, rows in groupby(ordered, key=lambda r: r.dim):
        yield int(dim), pd.DataFrame([tuple(r) for r in rows], columns=sums.columns)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (rows in the original order) with a = L L', columns by falling pivot,
    as many as the numerical rank."""
    a = a.copy()
    n = len(a)
    order = np.arange(n)
    factor = np.zeros((n, n))
    least = n * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    rank = 0
    for k in range(n):
        p = k + int(a.diagonal()[k:].argmax())
        if a[p, p] <= least:
            break
        if p != k:
            a[[k, p]] = a[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
            factor[[k, p]] = factor[[p, k]]
            order[[k, p]] = order[[p, k]]
        root = np.sqrt(a[k, k])
        factor[k, k] = root
        factor[k + 1:, k] = a[k + 1:, k] / root
        a[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
        rank += 1
    out = np.empty((n, rank))
    out[order] = factor[:, :rank]
    return out


def rounds_of_pairs(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of 0..n-1 as rounds of disjoint pairs (a tournament table)."""
    players = [*range(n), *([-1] if n % 2 else [])]
    half, out = len(players) // 2, []
    for _ in range(len(players) - 1):
        pairs = [(a, b) for a, b in zip(players[:half], players[:half - 1:-1]) if a >= 0 and b >= 0]
        out.append((np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)))
        players = [players[0], players[-1], *players[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor's columns rotated until every two are orthogonal."""
    f = np.asfortranarray(factor)
    rounds = rounds_of_pairs(f.shape[1]) if f.shape[1] > 1 else []
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in rounds:
            a, b = f[:, p], f[:, q]
            alpha, beta, gamma = (np.einsum("ij,ij->j", x, y) for x, y in ((a, a), (b, b), (a, b)))
            cosine = np.abs(gamma) / np.maximum(np.sqrt(alpha) * np.sqrt(beta), np.finfo(float).tiny)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > 1e-16
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            f[:, p], f[:, q] = c * a - c * t * b, c * t * a + c * b
        if worst < 4e-16 * np.sqrt(len(f)):
            break
    return f


@dataclass
class Whitener:
    """Exact moments and components of the vectors of one length."""

    n: int
    base: np.ndarray      # floor(S/n) per dimension
    rest: np.ndarray      # S - n * base
    axes: np.ndarray      # components as columns
    values: np.ndarray    # their eigenvalues of the covariance, falling
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as integers, in Python's where longs are too small."""
        d = x - self.base
        most = self.n * (int(np.abs(d).max(initial=0)) + 1)
        return (d if most < 1 << 62 else d.astype(object)) * self.n - self.rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x).astype(np.float64) / self.n) @ self.axes / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        c = self.centred(x)
        most = max((abs(int(v)) for v in (c.min(initial=0), c.max(initial=0))), default=0)
        c = c if most * most * max(c.shape[1], 1) < 1 << 63 else c.astype(object)
        return [v if v < 1 << 63 else None for v in map(int, (c * c).sum(axis=1))]


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """Whiteners by length of vector of ``scaled_rows``. Per length at most
    ``components`` axes and two rows of integers stay on the driver."""
    unique = write_shared(rows.select("dim", "x").distinct(), "whitening-fit")
    counts = {r.dim: r.n for r in unique.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    sums = partial_sums(unique, "decimal(38,0)", lambda dim, x: x.sum(axis=0, dtype=object), "whitening-sums")
    base, rest = {}, {}
    for dim, found in by_dim(sums):
        split = [divmod(int(v), counts[dim]) for v in found["value"]]
        base[dim], rest[dim] = (np.array([s[k] for s in split], np.int64) for k in (0, 1))
    products = partial_sums(unique, "decimal(38,0)", lambda dim, x: exact_products(x - base[dim]), "whitening-products")
    models = {}
    for dim, found in by_dim(products):
        n, r = counts[dim], rest[dim].astype(object)
        scatter = np.zeros((dim, dim), object)
        scatter[found["i"], found["j"]] = scatter[found["j"], found["i"]] = [int(v) for v in found["value"]]
        covariance = ((scatter * n - np.outer(r, r)) / (n * n)).astype(np.float64)
        turned = one_sided_jacobi(pivoted_cholesky(covariance))
        values = np.einsum("ij,ij->j", turned, turned)
        first = np.argsort(-values, kind="stable")[:components]
        models[dim] = Whitener(n, base[dim], rest[dim], turned[:, first] / np.sqrt(values[first]), values[first],
                               float(covariance.trace()))

    def moments(dim: int, x: np.ndarray) -> np.ndarray:
        # a last entry of one for the mean
        z = np.column_stack([models[dim].whiten(x), np.ones(len(x))])
        return z.T @ z

    # fixed decimals add up alike in any order; an entry has at most the count as its size
    for dim, found in by_dim(partial_sums(unique, "decimal(38,15)", moments, "whitening-check")):
        k, m = len(models[dim].values), np.zeros((len(models[dim].values) + 1,) * 2)
        m[found["i"], found["j"]] = m[found["j"], found["i"]] = [float(v) / counts[dim] for v in found["value"]]
        covariance = m[:k, :k] - np.outer(m[:k, k], m[:k, k])
        models[dim].identity_error = float(np.abs(covariance - np.eye(k)).max(initial=0.0))
    return models


WHITE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
    T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("explained", T.ArrayType(T.DoubleType())),
    T.StructField("identity_error", T.DoubleType())])


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation,
    whitened, explained, identity_error."""
    bound_batches(vectors.sparkSession)
    rows = scaled_rows(vectors.select("vec_id", "embedding"))
    models = fit(rows, components)

    @F.pandas_udf(WHITE)
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for xs in batches:
            lengths = xs.map(len).to_numpy()
            out = [None] * len(xs)
            for dim in np.unique(lengths):
                at, m = np.flatnonzero(lengths == dim), models[int(dim)]
                x = np.array(xs.iloc[at].to_list(), np.int64).reshape(len(at), dim)
                shares = m.values / m.trace if len(m.values) else m.values
                for row, dev, z in zip(at, m.deviation(x), m.whiten(x)):
                    out[row] = (m.n, dev, z, shares, m.identity_error)
            yield pd.DataFrame(out, columns=WHITE.names).astype({"n": "Int64", "deviation": "Int64"})

    return (rows.select("vec_id", project("x").alias("w"))
            .select("vec_id", "w.n", "w.deviation", F.col("w.identity_error").alias("identity_error"),
                    F.posexplode(F.arrays_zip("w.whitened", "w.explained")).alias("place", "axis"))
            .select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("axis.whitened").alias("whitened"),
                    F.col("axis.explained").alias("explained"), "identity_error"))
