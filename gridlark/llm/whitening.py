"""Whitening of embeddings by their principal components.

Entries become whole numbers, so counts and sums are exact. One pass finds the
number of vectors and their sums, MLlib's ``computeSVD`` over the centred rows
finds the components, and total variance comes from the exact deviations of all
rows, apart from the decomposition. What the driver holds is one matrix of
dimensions by dimensions.

Cases: rows with a null vector, a null, infinite or undefined entry (or one of
``WIDEST`` and more, whose steps are no exact number), or no entry at all take no
part; vectors of another length than most (ties: the longer)
neither, as one decomposition needs one length; repeated rows and ids count as
often as they stand; components without variance (an eigenvalue under
``LEAST`` of the largest) have no whitened value and no rows, so equal vectors
alone, or a single one, give none; a deviation beyond 64 bits is null; null ids
pass through; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import quoted

COMPONENTS = 8
#: Steps to one, and what is added so that entries are positive.
SCALE, SHIFT = 1024, 100_000
#: Entries from here on are beyond exact whole numbers in double precision.
WIDEST = 2.0**43
#: Eigenvalues under this share of the largest are rounding errors.
LEAST = 1e-12


@dataclass
class Fit:
    """Number and sums of the vectors, components as rows, their eigenvalues, and the bound of a deviation."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    bound: int


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The columns ``id`` and ``x``: the vectors that take part, in whole numbers."""
    entries = quoted(vector_col).cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < WIDEST))
    x = F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    found = vectors.where(quoted(vector_col).isNotNull() & (F.size(entries) > 0) & fine).select(quoted(id_col).alias("id"), x.alias("x"))
    sizes = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.where(F.size("x") == (sizes["d"] if sizes else 0))


def _totals(numbers: DataFrame) -> tuple[int, np.ndarray, int]:
    """Number, sums by dimension, and the widest range of a dimension: one row for each task, added up exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, None, None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n += len(x)
                sums = x.sum(axis=0) + (0 if sums is None else sums)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n])] + [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (sums, low, high)], names=["n", "s", "low", "high"])

    parts = numbers.select("x").mapInArrow(run, "n long, s array<long>, low array<long>, high array<long>")
    by_dim = parts.select("n", F.posexplode(F.arrays_zip("s", "low", "high")).alias("dim", "v")).groupBy("dim")
    rows = by_dim.agg(F.sum("n").alias("n"), F.sum("v.s").alias("s"), F.min("v.low").alias("low"), F.max("v.high").alias("high")).orderBy("dim").collect()  # one for each dimension
    if not rows:
        return 0, np.zeros(0, np.int64), 0
    return rows[0]["n"], np.array([r["s"] for r in rows], np.int64), max(r["high"] - r["low"] for r in rows)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(numbers: DataFrame) -> Fit:
    """Components of the centred rows of ``x`` by falling eigenvalue, divisor n."""
    n, sums, widest = _totals(numbers)
    if not n:
        return Fit(0, sums, np.zeros((0, 0)), np.zeros(0), 0)
    means = F.array(*[F.lit(float(m)) for m in sums / n])
    centred = numbers.select(array_to_vector(F.zip_with("x", means, lambda x, m: x - m)).alias("v"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v")).computeSVD(len(sums))
    values = np.array(found.s) ** 2 / n  # singular values of the rows, so squares over n
    kept = (values > 0) & (values > LEAST * values[:1].max(initial=0))
    return Fit(n, sums, found.V.toArray().T[: len(values)][kept], values[kept], len(sums) * (n * widest) ** 2)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` beside the id."""
    numbers = whole_numbers(vectors, id_col, vector_col)
    model = fit(numbers)
    k = min(components, len(model.values))
    n, sums, means, long_enough = model.n, model.sums, model.sums / max(model.n, 1), model.bound < 1 << 63
    turn = (model.components[:k] / np.sqrt(model.values[:k, None])).T if k else np.zeros((len(sums), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            if long_enough:
                apart = (n * x - sums) ** 2
                deviation = [Decimal(d) for d in apart.sum(axis=1).tolist()]
            else:  # whole numbers of any length
                deviation = [Decimal(sum((n * c - s) ** 2 for c, s in zip(row, sums.tolist(), strict=True))) for row in x.tolist()]
            made = (x - means) @ turn
            flat = pa.array(made.ravel())
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.decimal128(38, 0)), whitened], names=["id", "deviation", "w"])

    kind = numbers.schema["id"].dataType.simpleString()
    rows = numbers.mapInArrow(run, f"id {kind}, deviation decimal(38,0), w array<double>")
    if k:
        w = [F.col("w")[i] for i in range(k)]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        total, *covariance = rows.agg(F.sum("deviation"), *[F.covar_pop(w[i], w[j]) for i, j in pairs]).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs, strict=True))
        trace = float(total) / float(n) ** 3
        explained = [float(e / trace) for e in model.values[:k]]
    else:
        explained, error = [], 0.0
    part = F.array(*[F.lit(e) for e in explained]).cast("array<double>")
    long = rows.select("id", F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("w").alias("at", "whitened"))
    return long.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(part, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
