"""Operator 11: whitening components of embeddings by shifted CholeskyQR.

Vectors become integer vectors x = floor(256 c); the fit list holds each different x once, n in all, with sums S.
Its centred rows X = x - S / n are never formed as a matrix. A pass sends each row through the triangular solves
found so far and adds up the Gram matrix G of what comes out, task by task. The Cholesky factor R_k of G (plus a
shift of its diagonal, at first and while G is ill-conditioned) is the next triangular solve, so passes make the rows ever
more orthogonal: X = Q R_k ... R_1 with Q'Q = G of the last pass. The R factors are composed, what G still
lacks of the identity goes in as its square root, and the SVD of the result gives the eigenvectors of X'X. No pass
squares the condition of X, as an eigensolver for X'X would. The driver holds d by d matrices.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlake.llm.common import Scratch, table

#: Integers to a unit of a vector's entries, and components that are returned.
SCALE, COMPONENTS = 256, 4
#: Triangular factors at least (the first one shifted, two more to make up for it) and at most; more only sharpen what any
#: number of them gets right.
FACTORS, PASSES = 3, 8
#: What G of an orthogonal list may be off by; below NULL an eigenvalue of G is a direction that X doesn't have.
ORTHOGONAL, NULL = 1e-8, 1e-6
#: Components whose singular value is less than this share of the largest are rounding.
LEAST = 1e-12
#: Rows that are worked on at a time.
_STRIP = 4_096
_UNIT = float(np.finfo(np.float64).eps) / 2


class Whitening(NamedTuple):
    """n, sums: rows of the fit list and their sums by dimension. vectors: a unit component per column; values: its
    eigenvalue. trace: the sum of all eigenvalues. identity_error: how far the whitened list's covariance is from
    the identity. passes: Gram passes that the fit took."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int


def quantised(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, width, x array<long>), x = floor(256 c), of vectors that are there and whose entries are all finite.

    Entries beyond 2^53 / 256 can't be held exactly and are an error.
    """
    raw = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("v")).where(F.col("v").isNotNull())
    fine = raw.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    whole = lambda c: F.when(F.abs(c) < 2.0**53 / SCALE, F.floor(c * SCALE)).otherwise(F.raise_error(F.lit("an entry is too large to whiten exactly")).cast("long"))
    return fine.select("vec_id", F.size("v").alias("width"), F.transform("v", whole).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _strips(batches, column: int, width: int):
    for batch in batches:
        for at in range(0, batch.num_rows, _STRIP):
            piece = batch.slice(at, _STRIP)
            yield piece, _matrix(piece.column(column), width)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact."""
    if len(x) and n * max(abs(int(x.max())), abs(int(x.min()))) >= 2**62:
        raise OverflowError("entries times rows are beyond 64 bits")
    return n * x - sums


def square_sums(d: np.ndarray) -> pa.Array:
    """Sums of squares by row, exact, as decimal(38,0)."""
    most = max(abs(int(d.max())), abs(int(d.min()))) if d.size else 0
    if d.shape[1] * most**2 < 2**63:
        return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
    wide = d.astype(object)
    return pa.array([int(v) for v in (wide * wide).sum(1)], pa.decimal128(38, 0))


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverses of upper triangular factors, one after the other, by substitution from the first column on."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(rows.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def _entries(matrix: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(matrix))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(matrix[i, j])], ["i", "j", "g"])


def _gram(fit: DataFrame, width: int, n: int, sums: np.ndarray, after) -> np.ndarray:
    """The Gram matrix of `after` of the centred rows. A task adds up its rows; Spark adds up the tasks."""

    def run(batches):
        total = None
        for _, x in _strips(batches, 0, width):
            y = after(deviations(x, n, sums) / n)
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield _entries(total)

    rows = fit.mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow()  # d (d + 1) / 2 rows
    i, j, g = (rows.column(k).to_numpy() for k in range(3))
    out = np.zeros((int(i.max()) + 1,) * 2)
    out[i, j] = out[j, i] = g
    return out


def _column_sums(fit: DataFrame, width: int, of, kind: str) -> dict[int, float]:
    """Sums by column of of(x) over the fit list."""

    def run(batches):
        for _, x in _strips(batches, 0, width):
            total = of(x).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "s"])

    return {r["i"]: r["s"] for r in fit.mapInArrow(run, f"i int, s {kind}").groupBy("i").agg(F.sum("s").alias("s")).collect()}  # a row a column


def _shift(gram: np.ndarray, n: int, first: bool) -> float:
    """What keeps the Cholesky factor of G from breaking down by rounding; behind the first one, 0 for a well-conditioned G."""
    low, high = np.linalg.eigvalsh(gram)[[0, -1]]
    d = len(gram)
    return 0.0 if low > 0.25 * high and not first else 11 * (n * d + d * (d + 1)) * _UNIT * high


def fit_components(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of a stored fit list (x array<long> of `width` entries, rows distinct).

    At most `components`, by falling eigenvalue; directions without variance give none. A list of one vector has none.
    """
    n = fit.count()
    found = _column_sums(fit, width, lambda x: x, "long")
    sums = [int(found[k]) for k in range(width)]
    s = np.array(sums, dtype=np.int64)
    factors: list[np.ndarray] = []
    first = gram = _gram(fit, width, n, s, lambda y: y)
    trace = float(np.trace(first)) / n
    if not trace:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 1)
    while len(factors) < PASSES:
        held = np.linalg.eigvalsh(gram)
        if len(factors) >= FACTORS and ((np.abs(held - 1) < ORTHOGONAL) | (held < NULL)).all():
            break
        factors.append(np.linalg.cholesky(gram + _shift(gram, n, not factors) * np.eye(width)).T)
        gram = _gram(fit, width, n, s, lambda y, r=list(factors): solved(y, r))
    composed = np.eye(width)
    for r in factors:
        composed = r @ composed
    held, axes = np.linalg.eigh(gram)
    root = np.sqrt(np.where(held > NULL, held, 0.0))
    _, sigma, turned = np.linalg.svd((root[:, None] * axes.T) @ composed)
    keep = int((sigma[:components] > LEAST * sigma[0]).sum())
    vectors, values = np.ascontiguousarray(turned[:keep].T), sigma[:keep] ** 2 / n
    onto = lambda y: (y @ vectors) / np.sqrt(values)
    middle = _column_sums(fit, width, lambda x: onto(deviations(x, n, s) / n), "double")
    mean = np.array([middle[k] for k in range(keep)]) / n
    covariance = _gram(fit, width, n, s, lambda y: onto(y) - mean) / n
    return Whitening(n, sums, vectors, values, trace, float(np.abs(covariance - np.eye(keep)).max()), len(factors) + 1)


def _whitened(model: Whitening, width: int):
    """Arrow function (vec_id, x) -> a row per vector and component."""

    def run(batches):
        s, k = np.array(model.sums, dtype=np.int64), len(model.values)
        for piece, x in _strips(batches, 1, width):
            d = deviations(x, model.n, s)
            y = (d / model.n) @ model.vectors / np.sqrt(model.values)
            row = np.repeat(np.arange(len(x)), k)
            take, each = pa.array(row), lambda v: pa.array(np.tile(v, len(x)))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(take), each(np.arange(1, k + 1, dtype=np.int32)), each(np.full(k, model.n)), square_sums(d).take(take), pa.array(y.ravel()), each(model.values / model.trace), each(np.full(k, model.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, scratch: Scratch, components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row of `vectors` and component.

    vectors: vec_id, embedding array of numbers. deviation, the sum over dimensions of (n x - S)^2, is decimal(38,0), as
    it outgrows 64 bits on large lists. Null vectors and those with a null or non-finite entry are left out; rows that repeat a
    vec_id or have none stay. Vectors of different width are fitted apart; empty ones have no component.
    Other columns are not read; an empty table gives an empty one.
    """
    ids = T._parse_datatype_string("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    schema = T.StructType([T.StructField("vec_id", vectors.schema["vec_id"].dataType), *ids.fields])
    rows = quantised(vectors.select("vec_id", "embedding")).where("width > 0")
    lists = scratch.save(rows.select("width", "x").distinct(), "list")
    out = None
    for width in sorted(r[0] for r in lists.select("width").distinct().collect()):
        model = fit_components(lists.where(F.col("width") == width).select("x"), width, components)
        if len(model.values):
            part = rows.where(F.col("width") == width).select("vec_id", "x").mapInArrow(_whitened(model, width), schema)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], schema)


def op11_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings"), Scratch(spark, "whitening"))
    return out.withColumn("deviation", _long(F.col("deviation")))


def _long(column: Column) -> Column:
    """As long; what doesn't fit is an error, whatever the session's setting."""
    return F.when(column <= 2**63 - 1, column.cast("long")).otherwise(F.raise_error(F.lit("a deviation is beyond 64 bits")).cast("long"))
