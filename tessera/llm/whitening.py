"""Embedding whitening: the covariance's upper triangle as one aggregation of generated SQL expressions, decomposed by LAPACK."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare, written

#: x = floor(SCALE * entry) + SHIFT, a long.
SCALE, SHIFT = 1024, 100_000
#: Entries whose x would pass this aren't finite for this operator: beyond it a double no longer holds every long.
LARGEST = 2.0**52
#: Expressions of one aggregation. 128 dimensions make 8,256 pairs.
PAIRS = 8_256


def integers(vectors: DataFrame) -> DataFrame:
    """The rows whose vector holds only usable entries, with `x`, the entries as integers in doubles."""
    entry = lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("double") + F.lit(float(SHIFT))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * SCALE >= LARGEST)
    return vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", bad)).withColumn("x", F.transform("embedding", entry))


@dataclass(frozen=True)
class Whitening:
    """n rows with sums S, components (a row each, by falling eigenvalue) and their eigenvalues; trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def covariance_terms(d: int) -> list[tuple[int, int, str]]:
    """(i, j, SQL) for each pair of dimensions i <= j: the sum of the products of both centred entries z."""
    return [(i, j, f"sum(z{i} * z{j})") for i in range(d) for j in range(i, d)]


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of all rows (with `x`, all of one length); None without rows or dimensions.

    A first aggregation counts rows and sums each dimension; a second one sums the products of every pair of dimensions, each
    centred by the mean's nearest integer before it is multiplied. Both are rows of d and d (d + 1) / 2 numbers for each task,
    whatever the input. All summands are integers, so the sums are exact, and the same for any order of the rows, up to 2^53;
    what the rounded means leave is taken off in exact fractions. Over 128 dimensions, further aggregations take the rest.
    """
    d = rows.select(F.size("x")).first()
    d = d[0] if d else 0
    if not d:
        return None
    first = rows.selectExpr(*(f"x[{i}] AS x{i}" for i in range(d))).selectExpr("count(*)", *(f"sum(CAST(x{i} AS DECIMAL(18,0)))" for i in range(d))).first()
    n, sums = first[0], [int(s) for s in first[1:]]
    centre = [round(Fraction(s, n)) for s in sums]
    # no entry is null, which Spark can't see: coalesce() says so, and the generated code of each sum is a third
    centred = rows.selectExpr(*(f"coalesce(x[{i}] - {c}D, 0D) AS z{i}" for i, c in enumerate(centre)))
    terms = covariance_terms(d)
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    v = np.zeros((d, d))
    for at in range(0, len(terms), PAIRS):
        own = terms[at : at + PAIRS]
        for (i, j, _), total in zip(own, centred.selectExpr(*(t for _, _, t in own)).first(), strict=True):
            v[i, j] = v[j, i] = float((Fraction(total) * n - rest[i] * rest[j]) / (n * n))
    values, vectors = np.linalg.eigh(v)  # LAPACK's syevd, on a matrix of d x d
    order = np.argsort(values)[::-1]
    components = vectors[:, order].T
    turned = components * np.sign(components[np.arange(d), np.argmax(np.abs(components), axis=1)])[:, None]  # the largest entry is positive
    return Whitening(n, sums, turned, values[order], float(np.trace(v)))


def _projector(w: Whitening, kept: int):
    """Batches of (key, x) to (key, deviation, whitened of the first `kept` components)."""
    sums = np.array(w.sums, object)
    mean = np.array([float(Fraction(s, w.n)) for s in w.sums])
    with np.errstate(divide="ignore"):
        scaled = w.components[:kept].T / np.sqrt(w.values[:kept])
    whole, low = np.array([s // w.n for s in w.sums], np.int64), np.array([s % w.n for s in w.sums], np.int64)

    def deviations(x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2 exactly; None where a long can't hold it."""
        most = w.n * (int(np.abs(x - whole).max(initial=0)) + 1)
        if len(w.sums) * most * most < 1 << 63:
            y = w.n * (x - whole) - low
            return (y * y).sum(axis=1).tolist()
        exact = (((w.n * x.astype(object) - sums) ** 2).sum(axis=1)).tolist()
        return [e if e < 1 << 63 else None for e in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            y = (x - mean) @ scaled
            deviation = pa.array(deviations(x.astype(np.int64)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), deviation, pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * kept), pa.array(y.reshape(-1)))], ["vec_id", "deviation", "y"])

    return project


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue for each row and component up to `components`.

    An entry c becomes the integer x = floor(1024 c) + 100000. All rows whose vector is usable are the fit list: n rows with sums S
    by dimension. V is their covariance (divisor n). Components are V's unit eigenvectors, numbered from 1 by falling eigenvalue e,
    the largest entry positive. whitened is (x - S/n) projected on the component, over sqrt(e); explained is e over V's trace;
    deviation the exact sum over dimensions of (n x - S)^2, null where a long can't hold it; identity_error one value, the largest
    absolute entry of whitened's own covariance, taken over all rows again, minus the identity.

    Not usable, so without rows: null and empty vectors, vectors with a null, NaN or infinite entry or one of 2^42 or more, and
    vectors of another length than most have (of equally many, the longer). Repeated rows count each; null and repeated vec_ids
    are kept. Where fewer dimensions vary, components stop at V's rank (eigenvalues above 10^-12 of the first), so a
    single row, equal rows and an empty table give none. Further columns are ignored.

    The rows are read four times (lengths, sums, products, result) and never shuffled; what meets in one task or on the driver is a
    row of at most d (d + 1) / 2 sums for each task.
    """
    spark = prepare(vectors.sparkSession)
    rows = integers(vectors.select("vec_id", "embedding"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths["d"]).select(F.col("vec_id").cast("long"), "x")
    w = fit(rows)
    kept = 0 if w is None else int((w.values[:components] > max(0.0, w.values[0]) * 1e-12).sum())
    if not kept:
        return spark.createDataFrame([], schema)
    out = written(rows.mapInArrow(_projector(w, kept), "vec_id long, deviation long, y array<double>"), "whitened")
    y = out.selectExpr(*(f"y[{i}] AS y{i}" for i in range(kept)))
    means = y.selectExpr(*(f"avg(y{i})" for i in range(kept))).first()
    pairs = [(i, j) for i in range(kept) for j in range(i, kept)]
    own = y.selectExpr(*(f"avg((y{i} - {means[i]!r}D) * (y{j} - {means[j]!r}D))" for i, j in pairs)).first()
    error = max(abs(v - (i == j)) for (i, j), v in zip(pairs, own, strict=True))
    by_component = F.array(*(F.struct(F.lit(i + 1).alias("component"), F.lit(float(w.values[i] / w.trace)).alias("explained"), F.lit(float(w.values[i])).alias("eigenvalue")) for i in range(kept)))
    each = out.select("vec_id", "deviation", "y", F.explode(by_component).alias("c"))
    return each.select("vec_id", "c.component", F.lit(w.n).cast("long").alias("n"), "deviation", F.get("y", F.col("c.component") - 1).alias("whitened"), "c.explained", F.lit(float(error)).alias("identity_error"), "c.eigenvalue")
