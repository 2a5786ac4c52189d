"""Outlines with fewer corners: rings and lines simplified within a tolerance, all together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Corners of whole lines that are looked at together.
TOGETHER = 500_000


def _farthest(x: np.ndarray, y: np.ndarray, unknown: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch from ``low`` to ``high``, with corners between, the greatest distance from the straight line and the first corner that has it."""
    inner = high - low - 1
    first = np.concatenate([[0], np.cumsum(inner)[:-1]])
    own = np.repeat(np.arange(len(low)), inner)
    at = low[own] + 1 + np.arange(len(own)) - first[own]
    ax, ay = x[low], y[low]
    dx, dy = x[high] - ax, y[high] - ay
    long = dx * dx + dy * dy
    with np.errstate(all="ignore"):
        t = np.where(long[own] == 0, 0.0, ((x[at] - ax[own]) * dx[own] + (y[at] - ay[own]) * dy[own]) / long[own])
        t = np.maximum(0.0, np.minimum(1.0, t))
        off_x, off_y = ax[own] + t * dx[own] - x[at], ay[own] + t * dy[own] - y[at]
        far = np.sqrt(off_x * off_x + off_y * off_y)  # each step rounds as in SQL: by hypot, equal distances come out apart
    # as in SQL, what is not a number is farther than all others, and what is unknown is never far
    far = np.where(unknown[at] | (unknown[low] | unknown[high])[own], -np.inf, np.where(np.isnan(far), np.inf, far))
    most = np.maximum.reduceat(far, first)
    return most, np.minimum.reduceat(np.where(far == most[own], at, len(x)), first)


def _kept(x: np.ndarray, y: np.ndarray, unknown: np.ndarray, starts: np.ndarray, ends: np.ndarray, tolerance: float) -> np.ndarray:
    """Which corners of lines, each from its start to its end, stay: all stretches of all lines are split together until none is left to split."""
    kept = np.zeros(len(x), bool)
    kept[starts] = kept[ends - 1] = True
    low, high = starts, ends - 1
    while (open_ := high - low > 1).any():
        low, high = low[open_], high[open_]
        most, mid = _farthest(x, y, unknown, low, high)
        split = most > tolerance
        low, mid, high = low[split], mid[split], high[split]
        kept[mid] = True
        low, high = np.concatenate([low, mid]), np.concatenate([mid, high])
    return kept


def simplified(lines: DataFrame, key: str, points: str, tolerance: float, closed: bool = False) -> DataFrame:
    """(key, points): the corners that farthest-point splitting keeps, in order.

    A stretch between two kept corners keeps its farthest corner too, if that
    lies over ``tolerance`` from the straight line (of equals the first). A line
    stands on one row before and after, so it is split on its row, and all
    stretches of the lines of a batch are split together: no round passes the
    driver, and lines of any depth are split to the end. A ring (``closed``)
    begins at its first corner and is first split at the corner farthest from
    it. Lines of one or two corners stay as they are.
    """
    rows = lines.select(F.col(key).alias("k"), F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("p")).where(F.size("p") > 0)

    def split(held: pa.ListArray) -> pa.ListArray:
        corner, n = held.flatten(), held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(n) - n
        long = n + (closed & (n > 1))  # a ring's first corner closes it
        ends = np.cumsum(long)
        starts = ends - long
        own = np.repeat(np.arange(len(n)), long)
        nth = np.arange(len(own)) - starts[own]
        at, closing = begin[own] + nth % n[own], nth >= n[own]
        x, y = (pa.compute.cast(corner.field(c), pa.float64()) for c in (0, 1))
        unknown = (x.is_null().to_numpy(zero_copy_only=False) | y.is_null().to_numpy(zero_copy_only=False))[at]
        x, y = (v.to_numpy(zero_copy_only=False)[at] for v in (x, y))
        stay = _kept(x, y, unknown, starts, ends, tolerance) & ~closing
        counts = np.bincount(own[stay], minlength=len(n))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), corner.take(pa.array(at[stay])))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            bounds = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(bounds)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                part = batch.slice(low, high - low)
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([part.column(0), split(part.column(1))], names=["k", "p"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(batches, f"k {kinds['k']}, p {kinds['p']}").select(F.col("k").alias(key), F.col("p").alias("points"))
