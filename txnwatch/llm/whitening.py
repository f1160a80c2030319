"""Embedding whitening with exactly computed principal components.

Entries become whole numbers, x = floor(64 c) + 1,000,000, so that sums and the scatter matrix are exact
and do not depend on the order of the rows:

1. sums per dimension, then the scatter of the rows less a whole-number centre; tasks add up their rows,
   Spark adds up the tasks;
2. n times the scatter less the sums' product is n^2 times the covariance, a matrix of integers. Tasks
   take its characteristic polynomial modulo primes; Chinese remainders give the polynomial itself;
   its largest roots are isolated and refined exactly (``charpoly``); tasks find the components by
   inverse iteration;
3. every row is projected in its task; the covariance of what came out is measured over all rows.

The driver holds matrices of the dimension only. All four passes read the rows without a shuffle of
them.

Dropped are vectors that are null or hold a null or non-finite entry, and those whose length is not the most
frequent one (the longer of two equally frequent). 64 c saturates at 2^52. Components of eigenvalue
0 do not exist: fewer than two different vectors, or an empty table, give no rows. ``deviation`` is null
where it exceeds a long. Null ids stay, repeated rows count as often as they occur, other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.llm import charpoly

COMPONENTS = 32
UNITS, OFFSET = 64, 1_000_000  # fixed values of the rounding
LARGEST = float(1 << 52)
EXACT_DOUBLE, EXACT_LONG = 1 << 53, (1 << 63) - 1
HALF, TOTALS = 10**18, "place int, low long, high string"


class Fit:
    """What the fit list says: sums, scatter, and the components with their eigenvalues."""

    def __init__(self, rows: DataFrame, dimension: int, components: int = COMPONENTS):
        self.n, self.sums = _sums(rows, dimension)
        # x less a whole number near its mean; what is left of the sums stays exact.
        self.centre = [round(Fraction(s, self.n)) for s in self.sums] if self.n else [0] * dimension
        self.rest = [s - self.n * c for s, c in zip(self.sums, self.centre)]
        self.matrix = self._matrix(rows)
        self.trace = sum(self.matrix[i][i] for i in range(dimension))
        self.roots, self.scale, self.vectors = self._components(rows.sparkSession, components)

    def _matrix(self, rows: DataFrame) -> list[list[int]]:
        """n^2 times the covariance."""
        d = len(self.centre)
        scatter = [[0] * d for _ in range(d)]
        for i, j, total in _scatter(rows, self.centre):
            scatter[i][j] = scatter[j][i] = total
        return [[self.n * scatter[i][j] - self.rest[i] * self.rest[j] for j in range(d)] for i in range(d)]

    def _components(self, spark, most: int) -> tuple[list[int], int, np.ndarray]:
        d = len(self.matrix)
        if not self.trace:
            return [], 0, np.zeros((0, d))
        found = charpoly.combine(_residues(spark, self.matrix))
        roots, scale = charpoly.eigenvalues(found, most)
        vectors = _null_spaces(spark, self.matrix, roots, scale)
        return [root for root, times in roots for _ in range(times)][:most], scale, vectors[:most]

    @property
    def explained(self) -> list[float]:
        return [float(Fraction(root, self.trace << self.scale)) for root in self.roots]

    @property
    def projection(self) -> tuple[np.ndarray, np.ndarray]:
        """(shift, weights): whitened = (x - centre - shift) @ weights."""
        shift = np.array([float(Fraction(r, self.n)) for r in self.rest])
        spread = [float(Fraction(root, self.n * self.n << self.scale)) ** 0.5 for root in self.roots]
        return shift, self.vectors.T / np.array(spread)


def whitened(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows, dimension = finite_vectors(embeddings, id_column, vector)
    fit = Fit(rows, dimension, components)
    kind = dict(rows.dtypes)["id"]
    error = _identity_error(rows, fit) if fit.roots else 0.0
    projected = rows.mapInArrow(_projector(fit), f"id {kind}, deviation long, whitened array<double>")
    explained = F.array(*[F.lit(x) for x in fit.explained]) if fit.roots else F.array(F.lit(0.0))
    return projected.select("id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        F.col("id").alias(id_column),
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def finite_vectors(embeddings: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v): the usable vectors as doubles, and their length."""
    rows = embeddings.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    rows = rows.where(F.col("v").isNotNull() & F.forall("v", finite))
    lengths = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    dimension = lengths["length"] if lengths else 0
    return rows.where(F.size("v") == dimension), dimension


def _whole(column: pa.Array, d: int) -> np.ndarray:
    """The entries as whole numbers, without the offset."""
    entries = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
    return np.clip(np.floor(UNITS * entries), -LARGEST, LARGEST).astype(np.int64)


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0))


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of x per dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = _whole(batch.column("v"), d)
            x = x if _largest(x) * len(x) < EXACT_LONG else x.astype(object)
            n += len(x)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0))]
        yield _totals([(-1, n), *enumerate(total)])

    added = rows.select("v").mapInArrow(add, TOTALS)
    found = dict(_added(added))
    n = found.pop(-1, 0)
    return n, [found.get(i, 0) + OFFSET * n for i in range(d)]


def _scatter(rows: DataFrame, centre: list[int]) -> list[tuple[int, int, int]]:
    """Exact sums of products of the centred entries, upper triangle."""
    d = len(centre)
    shift = np.array([c - OFFSET for c in centre], np.int64)
    upper = [(i, j) for i in range(d) for j in range(i, d)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            y = _whole(batch.column("v"), d) - shift
            # Sums of whole numbers below 2^53 are exact in doubles, in any order.
            y = y.astype(np.float64) if _largest(y) ** 2 * len(y) < EXACT_DOUBLE else y.astype(object)
            product = y.T @ y
            total += product.astype(np.int64).astype(object) if product.dtype == np.float64 else product
        yield _totals([(i * d + j, total[i, j]) for i, j in upper])

    added = rows.select("v").mapInArrow(add, TOTALS)
    return [(place // d, place % d, total) for place, total in _added(added)]


def _totals(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    """Whole numbers of any size, as the rest and the multiple of HALF."""
    parts = [(place, *reversed(divmod(int(total), HALF))) for place, total in pairs]
    places, low, high = zip(*parts) if parts else ((), (), ())
    columns = [pa.array(places, pa.int32()), pa.array(low, pa.int64()), pa.array([str(x) for x in high], pa.string())]
    return pa.record_batch(columns, names=["place", "low", "high"])


def _added(parts: DataFrame) -> list[tuple[int, int]]:
    """Whole totals over all tasks."""
    low, high = F.col("low").cast("decimal(28,0)"), F.col("high").cast("decimal(38,0)")
    summed = parts.groupBy("place").agg(F.sum(low).alias("low"), F.sum(high).alias("high"))
    return [(r["place"], int(r["low"]) + HALF * int(r["high"])) for r in summed.collect()]


def _residues(spark, matrix: list[list[int]]) -> dict[int, list[int]]:
    """The characteristic polynomial modulo as many primes as its coefficients need; a task per few primes."""
    needed = charpoly.primes(charpoly.primes_needed(matrix))

    def residues(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"p": frame["p"], "c": [charpoly.residues(matrix, int(p)) for p in frame["p"]]})

    listed = spark.createDataFrame([(p,) for p in needed], "p long").repartition(-(-len(needed) // 4))
    return {r["p"]: list(r["c"]) for r in listed.mapInPandas(residues, "p long, c array<long>").collect()}


def _null_spaces(spark, matrix: list[list[int]], roots: list[tuple[int, int]], scale: int) -> np.ndarray:
    """Components of the roots, in their order; a task per few roots."""

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [charpoly.null_space(matrix, int(r), int(m), scale) for r, m in zip(frame["root"], frame["times"])]
            yield pd.DataFrame({"place": frame["place"], "v": found})

    listed = spark.createDataFrame([(i, str(r), m) for i, (r, m) in enumerate(roots)], "place int, root string, times int")
    found = listed.repartition(min(len(roots), 64)).mapInPandas(vectors, "place int, v array<array<double>>").collect()
    return np.array([v for r in sorted(found, key=lambda r: r["place"]) for v in r["v"]])


def _project(y: np.ndarray, fit_shift: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (y.astype(np.float64) - fit_shift) @ weights


def _identity_error(rows: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    d, k = len(fit.centre), len(fit.roots)
    offset = np.array([c - OFFSET for c in fit.centre], np.int64)
    shift, weights = fit.projection

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = _project(_whole(batch.column("v"), d) - offset, shift, weights)
            products += w.T @ w
            sums += w.sum(axis=0)
        values = np.concatenate([products.ravel(), sums])
        yield pa.record_batch([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["place", "total"])

    parts = rows.select("v").mapInArrow(add, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
    values = np.zeros(k * k + k)
    for r in parts.collect():
        values[r["place"]] = r["total"]
    mean = values[k * k :] / fit.n  # rounding only: the rows are centred
    return float(np.abs(values[: k * k].reshape(k, k) / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def _projector(fit: Fit):
    d, n, rest = len(fit.centre), fit.n, fit.rest
    offset = np.array([c - OFFSET for c in fit.centre], np.int64)
    (shift, weights) = fit.projection if fit.roots else (np.zeros(d), np.zeros((d, 0)))
    most_rest = max(map(abs, rest), default=0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _whole(batch.column("v"), d) - offset
            small = (n * _largest(y) + most_rest) ** 2 * d <= EXACT_LONG
            gaps = n * (y if small else y.astype(object)) - np.array(rest, np.int64 if small else object)
            deviation = [int(x) if x <= EXACT_LONG else None for x in (gaps * gaps).sum(axis=1).tolist()]
            w = _project(y, shift, weights)
            lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.array(w.ravel()))
            yield pa.record_batch([batch.column("id"), pa.array(deviation, pa.int64()), lists], names=["id", "deviation", "whitened"])

    return project
