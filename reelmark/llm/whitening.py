"""Whitening of vectors by the leading components of their covariance, found by LOBPCG.

Each step makes one distributed pass: tasks centre their rows and multiply them into a block of
directions (iterate, residual and previous directions, made orthonormal), and the covariance's
product with the block, dimensions by directions, is summed up in Spark. Rayleigh-Ritz on that small
product gives the next iterate. As each product is with the whole block, the residuals are those of
the covariance itself, and the steps end only when all wanted ones are below the tolerance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.llm.common import Scratch, table

COMPONENTS = 8
#: Directions of the iterate besides the wanted ones: the steps converge by the gap below the last of them.
GUARD = 8
#: Largest residual of a wanted component, as a part of the greatest eigenvalue.
TOLERANCE = 1e-13
#: Residuals that rounding keeps from the tolerance are accepted up to this part, once they no longer fall; a larger one is an error.
ROUNDED = 1e-10
MOST_STEPS = 500
#: Eigenvalues below this part of the greatest are rounding: such components are not there.
RANK = 1e-12
#: Entries of this size or more have no exact integer double, so that no sum of theirs is exact.
GREATEST = float(2**53)


def integer_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x) of ``rows`` with vectors of finite entries c, x being floor(1024 c) + 100000 as an array of longs.

    Left out are rows whose vector is null or empty, has a null, NaN or infinite entry or one beyond
    2^53 once scaled, or has another length than most vectors (ties: the longer).
    """
    c = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * 1024.0))
    good = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * 1024.0 < GREATEST - 100_000))
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(good).select(F.col(key).alias("key"), F.transform(c, lambda v: v + 100_000).alias("x"))
    sizes = kept.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return kept.where(F.size("x") == (sizes[0]["size"] if sizes else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


#: Rows centred and multiplied at once.
ROWS_AT_ONCE = 4096


class Vectors:
    """The fit list: integer vectors in the shared folder, their number and the exact sum of each dimension."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        found = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum("v").alias("s")).orderBy("i").collect()  # a row for each dimension
        self.n = found[0]["n"] if found else 0
        self.sums = [r["s"] for r in found]
        self.mean = np.array(self.sums, float) / max(self.n, 1)

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times ``block`` (dimensions by directions), in one pass.

        Tasks centre their rows before they multiply and give one row for each dimension; those are
        summed in Spark, so that the driver gets as many rows as there are dimensions.
        """
        sent, mean = self.rows.sparkSession.sparkContext.broadcast(block), self.mean  # of fixed size: dimensions by directions
        width = block.shape[1]
        names = [f"p{j}" for j in range(width)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(mean), width))
            for batch in batches:
                every = _matrix(batch)
                for at in range(0, len(every), ROWS_AT_ONCE):
                    centred = every[at : at + ROWS_AT_ONCE] - mean
                    total += centred.T @ (centred @ sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean))), *(pa.array(c) for c in total.T)], ["i", *names])

        parts = self.rows.select("x").mapInArrow(run, ", ".join(["i long", *(f"{c} double" for c in names)]))
        found = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).collect()
        sent.unpersist()
        out = np.zeros((len(mean), width))
        for r in found:
            out[r["i"]] = r[1:]
        return out / max(self.n, 1)

    def summed(self, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """``part`` of centred rows, an array of ``size`` sums, added up over all rows."""
        mean = self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                every = _matrix(batch)
                for at in range(0, len(every), ROWS_AT_ONCE):
                    total += part(every[at : at + ROWS_AT_ONCE] - mean).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "v"])

        out = np.zeros(size)
        for r in self.rows.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"]
        return out

    def trace(self) -> float:
        """The sum of the variances."""
        return float(self.summed(lambda centred: np.array([(centred**2).sum()]), 1)[0]) / max(self.n, 1)

    def identity_error(self, axes: np.ndarray) -> float:
        """The largest absolute entry of the covariance of the rows' coordinates on ``axes``, minus the identity."""
        count = axes.shape[1]

        def part(centred: np.ndarray) -> np.ndarray:
            z = centred @ axes
            return np.vstack([z.sum(axis=0), z.T @ z])

        sums = self.summed(part, (count + 1) * count).reshape(count + 1, count) / self.n
        return float(np.abs(sums[1:] - np.outer(sums[0], sums[0]) - np.eye(count)).max())


def orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the blocks' columns, those of earlier blocks first; dependent ones are left out.

    Each block is projected off the basis twice and scaled, so that rounding leaves no part of it behind.
    """
    basis = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        for column in block.T:
            size = np.linalg.norm(column)
            if size == 0 or basis.shape[1] >= len(column):
                continue
            column = column / size
            for _ in range(2):
                column = column - basis @ (basis.T @ column)
            left = np.linalg.norm(column)
            if left > 1e-8:
                column = column / left
                column = column - basis @ (basis.T @ column)
                basis = np.column_stack([basis, column / np.linalg.norm(column)])
    return basis


def lobpcg(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int = COMPONENTS, guard: int = GUARD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` greatest eigenvalues, falling, their unit eigenvectors as columns, and the largest relative residual.

    ``product`` multiplies the symmetric operator of ``size`` dimensions into a block. The start is a
    fixed draw. Residuals are taken off the product with the very block; the steps end when all
    wanted ones are within ``tolerance`` of the greatest eigenvalue, or no longer fall and are within
    ROUNDED; otherwise they raise.
    """
    wanted = min(wanted, size)
    width = min(wanted + guard, size)
    basis = orthonormal([np.random.default_rng(20).standard_normal((size, width))])
    least, stalled = np.inf, 0
    for _ in range(MOST_STEPS):
        image = product(basis)
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        chosen = vectors[:, ::-1][:, :width]
        values = values[::-1][:width]
        iterate = basis @ chosen
        residual = image @ chosen - iterate * values
        # What the new iterate has besides the old one's directions.
        previous = basis[:, width:] @ chosen[width:] if basis.shape[1] > width else None
        greatest = max(abs(float(values[0])), np.finfo(float).tiny)
        worst = float(np.linalg.norm(residual[:, :wanted], axis=0).max()) / greatest
        if worst <= tolerance or greatest == np.finfo(float).tiny:
            return values[:wanted], iterate[:, :wanted], worst
        least, stalled = (worst, 0) if worst < least / 2 else (least, stalled + 1)
        if stalled >= 8 and worst <= ROUNDED:
            return values[:wanted], iterate[:, :wanted], worst
        basis = orthonormal([iterate, residual] + ([previous] if previous is not None else []))
    raise ArithmeticError(f"residual {worst} after {MOST_STEPS} steps")


WHITENED = "key {key}, component int, n long, deviation decimal(38,0), whitened double, explained double"


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums over the dimensions of (n x - S)^2; in 64 bits where these hold them, else in Python's integers."""
    bound = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(abs(v) for v in sums)
    if bound * bound * x.shape[1] < 2**63:
        return pa.array(((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    spread = x.astype(object) * n - np.array(sums, object)
    return pa.array([Decimal(int(v)) for v in (spread * spread).sum(axis=1)], pa.decimal128(38, 0))


def whiten(spark: SparkSession, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The coordinates of every usable row of ``rows`` in the leading components, each of variance one.

    Columns: the key, component (from 1, by falling eigenvalue), n, deviation (decimal: exact at any
    size), whitened, explained, identity_error (of all whitened rows). Usable rows are those of
    ``integer_vectors``; all of them are fitted and come back, rows that repeat a key or a vector too,
    null keys included. Components whose eigenvalue is rounding (RANK) are left out: fewer than
    ``components`` come back where vectors vary in fewer dimensions, none where all are equal, and
    no rows come from an empty table.
    """
    scratch = Scratch(spark, "whitening")
    fit = Vectors(scratch.write(integer_vectors(rows, key, vector)))
    kind = dict(rows.dtypes)[key]
    if fit.n:
        values, vectors, _ = lobpcg(fit.product, len(fit.mean), components)
        trace = fit.trace()
        there = values > RANK * max(values[0], np.finfo(float).tiny) if trace > 0 else np.zeros(len(values), bool)
        values, vectors = values[there], vectors[:, there]
    else:
        values, vectors, trace = np.zeros(0), np.zeros((0, 0)), 0.0
    n, sums, mean, count = fit.n, fit.sums, fit.mean, len(values)
    axes, explained = vectors / np.sqrt(values), values / trace if trace else values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if count else ():
            every = _matrix(batch)
            for at in range(0, len(every), ROWS_AT_ONCE):
                x = every[at : at + ROWS_AT_ONCE]
                z = (x - mean) @ axes
                who = np.repeat(np.arange(at, at + len(x)), count)
                far = deviations(x, n, sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(who)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(who), n)),
                        far.take(pa.array(who - at)), pa.array(z.ravel()), pa.array(np.tile(explained, len(x))),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained"],
                )

    error = fit.identity_error(axes) if count else 0.0
    found = fit.rows.mapInArrow(run, WHITENED.format(key=kind))
    return found.withColumnRenamed("key", key).withColumn("identity_error", F.lit(error))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of ``embeddings`` in the first eight components; a deviation beyond a long is null."""
    found = whiten(spark, table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
