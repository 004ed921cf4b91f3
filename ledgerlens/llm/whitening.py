"""Embedding whitening (operator 13): weighted multiplicity covariance over distinct integer vectors.

1. Entries become whole numbers x = floor(scale * c), vectors 128-bit keys of them; equal vectors are one row with a count.
2. Counts and sums of the fit list are exact (whole numbers). Its covariance is a weighted GEMM of centred blocks within
   tasks; the partial matrices are added row by row of the matrix, each row in one place, never all in one task.
3. Only the covariance (dimension squared) comes to the driver, which takes its eigenvectors.
4. Each distinct vector is whitened once; the rows join back by key, between plain shuffles, so that a vector that a
   third of all rows hold is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, id_type, table

SCALE, COMPONENTS = 256, 4
WIDEST = 8192  #: entries of a vector: the covariance (512 MB then) is the only thing the driver holds
FLAT = 1e-12  #: components with no more than this share of the variance can't be whitened
_ROWS = 4096  #: vectors in one block of the GEMM


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of ``rows`` (vec_id, embedding): vectors that are null or hold null or non-finite entries are dropped."""
    whole = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    # NaN and the infinities are the doubles whose product with 0 isn't 0
    finite = whole.where("c IS NOT NULL AND size(c) > 0 AND forall(c, e -> e IS NOT NULL AND e * 0 = 0)")
    return finite.select("vec_id", F.transform("c", lambda e: F.floor(e * scale).cast("long")).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """One row a task: the weight and the weighted sum per dimension, as text since they are exact whole numbers of any size."""
    n, total = 0, np.zeros(dim, object)
    for batch in batches:
        x, w = _matrix(batch.column(0), dim), batch.column(1).to_numpy()
        for lo in range(0, len(x), _ROWS):
            part, weight = x[lo : lo + _ROWS], w[lo : lo + _ROWS]
            n += int(weight.sum())
            small = not len(part) or max(int(part.max()), -int(part.min())) * int(weight.sum()) < 1 << 62
            total += (weight @ part).astype(object) if small else (part.astype(object) * weight.astype(object)[:, None]).sum(0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(["n", *map(str, range(dim))]), pa.array([str(n), *map(str, total)])], ["what", "value"])


def _gram(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's weighted sum of products of centred vectors, a row of the matrix each."""
    dim = len(mean)
    total, some = np.zeros((dim, dim)), False
    for batch in batches:
        x, w = _matrix(batch.column(0), dim), batch.column(1).to_numpy()
        for lo in range(0, len(x), _ROWS):
            centred = x[lo : lo + _ROWS] - mean
            total += (centred * w[lo : lo + _ROWS, None]).T @ centred
            some = True
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.ListArray.from_arrays(np.arange(dim + 1, dtype=np.int32) * dim, total.ravel())], ["i", "row"])


def _added(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Sums of the partial rows of the matrix that meet in this task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), dim), strict=True):
            total[i] = total[i] + row if i in total else row.copy()
    for i, row in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row], pa.list_(pa.float64()))], ["i", "row"])


def _covariance(fit: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance (divisor n) of ``fit`` (x, w) around ``mean``."""
    dim = len(mean)
    parts = fit.mapInArrow(lambda batches: _gram(batches, mean), "i int, row array<double>")
    rows = parts.repartition("i").mapInArrow(lambda batches: _added(batches, dim), "i int, row array<double>").toArrow()
    out = np.zeros((dim, dim))
    out[rows.column("i").to_numpy()] = _matrix(rows.column("row").combine_chunks(), dim)
    return (out + out.T) / (2 * n)


@dataclass
class Whitening:
    """n vectors with sums S per dimension; falling eigenvalues and the eigenvectors in columns; explained shares."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def fit(distinct: DataFrame, dim: int, components: int = COMPONENTS, weights: str = "one") -> Whitening | None:
    """``distinct`` is (x, count), a row per vector; each has weight one, or with ``weights`` "count" its number of copies.

    Components without variance are left out (all, if no vectors differ); without vectors there is no fit. Eigenvectors
    have their largest entry positive.
    """
    weighted = distinct.select("x", (F.col("count") if weights == "count" else F.lit(1)).cast("long").alias("w"))
    sums = weighted.mapInArrow(lambda batches: _sums(batches, dim), "what string, value string")
    exact = dict(sums.groupBy("what").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")).collect())
    if not exact:
        return None
    n, total = int(exact["n"]), [int(exact[str(k)]) for k in range(dim)]
    # exact quotients of whole numbers: the mean is the nearest double
    v = _covariance(weighted, np.array([s / n for s in total]), n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    trace = float(np.trace(v))
    order = [k for k in order[:components] if values[k] > FLAT * trace]
    vectors = vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))]) if order else vectors
    return Whitening(n, total, values[order], vectors, values[order] / trace if order else values[order])


def _whiten(batches: Iterator[pa.RecordBatch], by: Whitening) -> Iterator[pa.RecordBatch]:
    """Per distinct vector its whitened components and its exact deviation, sum of (n * x - S) ** 2."""
    dim, n = len(by.sums), by.n
    mean, scale = np.array([s / n for s in by.sums]), by.vectors / np.sqrt(by.values)
    k = scale.shape[1]
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            x = _matrix(part.column(2), dim)
            y = (x - mean) @ scale
            farthest = max(n * max(abs(int(x.max())), abs(int(x.min()))), max(map(abs, by.sums)))
            if (2 * farthest) ** 2 * dim < 1 << 63:
                deviation = pa.array(((n * x - np.array(by.sums, np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
            else:
                off = n * x.astype(object) - np.array(by.sums, object)
                deviation = pa.array([Decimal(int(d)) if d < 10**38 else None for d in (off**2).sum(1)], pa.decimal128(38, 0))
            whitened = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * k, y.ravel())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), deviation, whitened, part.column(3)], ["k1", "k2", "deviation", "whitened", "w"])


def whiten(rows: DataFrame, components: int = COMPONENTS, weights: str = "one", scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) for ``rows`` (vec_id, embedding).

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are those of another length than
    most (of equally frequent lengths: the longest). The fit list is each distinct vector once, or with ``weights``
    "count" each row. Components number from 1 by falling variance, at most as many as the vectors have variance in;
    an empty table, or one with a single vector, gives no rows. Rows that repeat a vec_id, or have none, each
    get their own. vec_id may be of any type. The files that the result reads stay in the shared folder.
    """
    spark, kind = rows.sparkSession, id_type(rows, "vec_id")
    none = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    x = whole_vectors(rows, scale)
    length = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return none
    dim = length["d"]
    if dim > WIDEST:
        raise ValueError(f"vectors of over {WIDEST} entries")
    x = x.where(F.size("x") == dim)
    distinct = cut(x.groupBy("x").agg(F.count("*").alias("count")))
    by = fit(distinct, dim, components, weights)
    if not len(by.values):
        drop_cut(distinct)
        return none
    keys = [F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(1), "x").alias("k2")]
    small = distinct.select(*keys, "x", (F.col("count") if weights == "count" else F.lit(1)).cast("long").alias("w"))
    white = cut(small.mapInArrow(lambda batches: _whiten(batches, by), "k1 long, k2 long, deviation decimal(38,0), whitened array<double>, w long"))
    drop_cut(distinct)
    means = white.agg(*[(F.sum(F.col("whitened")[k] * F.col("w")) / by.n) for k in range(len(by.values))]).first()
    error = float(np.abs(_covariance(white.select("whitened", "w"), np.array(means, float), by.n) - np.eye(len(by.values))).max())
    back = cut(x.select("vec_id", *keys)).join(white, ["k1", "k2"])
    out = back.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, map(float, by.explained))), F.col("at") + 1)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that doesn't fit a long (tables of some 10 million distinct vectors and more) is null."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumn("deviation", F.expr("try_cast(deviation AS LONG)"))
