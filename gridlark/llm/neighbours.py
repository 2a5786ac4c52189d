"""Nearest neighbours by cosine, over randomly rotated one-bit codes.

Every vector is turned by a random rotation and keeps one bit for each
dimension, with the inner product of the vector and its code. From these the
inner product with a query is estimated without bias, and an error bound says
how far off an estimate can be. Only vectors whose upper bound reaches the
k-th best score found so far are compared exactly.

Vectors are dealt to blocks by a hash of their id; the stated queries go to
every block, where codes are made once and queries follow a few at a time; the
best of each block are compared at the end. Blocks are as large as memory
allows, as each meets all queries.

Cases: vectors that are null, empty, all zeros or hold a null or non-finite
entry, and rows without an id take no part; only vectors of equal length are
compared; rows under a query's own id are never its neighbours; repeated rows
count once, and of different vectors under one id the best counts; ties go to
the smaller id; fewer candidates than k give fewer rows; an empty table gives
no rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.llm.common import quoted

K = 5
#: Queries are the ids that this divides.
EVERY = 50
#: Standard errors of an estimate that a bound allows for: about one in a thousand lies beyond three.
ERRORS = 3.0
#: Bytes of vectors in a block, and cells of a table of estimates.
BLOCK_BYTES, CELLS = 128 << 20, 4_000_000
SEED = 7

_rotations: dict[int, np.ndarray] = {}


def rotation(dims: int) -> np.ndarray:
    """A random rotation, the same in every process."""
    if dims not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
        _rotations[dims] = (q * np.sign(np.diag(r))).astype(np.float32)
    return _rotations[dims]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors over their largest entry, so that no square overflows or vanishes; cosines stay as they are."""
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact cosines in double precision, each row computed alone and so the same wherever it stands."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors, and the inner product of each unit vector with its unit code."""
    turned = _unit(vectors) @ rotation(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(np.float32(vectors.shape[1]))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))).astype(np.float32)


class Block:
    """Candidates of one length with their codes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        if len(np.unique(ids)) < len(ids):  # repeated rows count once
            seen = np.unique(np.rec.fromarrays([ids, [v.tobytes() for v in vectors]]), return_index=True)[1]
            ids, vectors = ids[np.sort(seen)], vectors[np.sort(seen)]
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.repeated = len(np.unique(ids)) < len(ids)
        self.bits, factor = codes(scaled(self.vectors.astype(np.float64)))
        self.over = 1 / factor
        self.bound = ERRORS * np.sqrt(np.maximum(0, 1 - factor * factor)) / factor / np.sqrt(max(1, vectors.shape[1] - 1))

    def estimates(self, turned: np.ndarray) -> np.ndarray:
        """Estimated cosines of rotated unit queries (rows) with all candidates, from the packed bits."""
        dims = turned.shape[1]
        out = np.empty((len(turned), len(self.ids)), np.float32)
        step = max(1, CELLS // dims)
        whole = turned.sum(axis=1, keepdims=True)
        for at in range(0, len(self.ids), step):
            ones = np.unpackbits(self.bits[at : at + step], axis=1, count=dims).astype(np.float32)
            out[:, at : at + step] = (2 * (turned @ ones.T) - whole) / np.sqrt(np.float32(dims)) * self.over[at : at + step]
        return out

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """Query, candidate and exact cosine of the k best of this block."""
        exact = scaled(queries.astype(np.float64))
        found = self.estimates(_unit(exact) @ rotation(queries.shape[1]))
        for own, query, estimate in zip(ids.tolist(), exact, found, strict=True):
            estimate[self.ids == own] = -np.inf
            upper = estimate + self.bound
            first = np.argpartition(-estimate, min(4 * k, len(estimate)) - 1)[: 4 * k]
            best = self._best(first[estimate[first] > -np.inf], query, k)
            if len(best) == k:  # else fewer are found than asked for, so all are compared
                rest = np.flatnonzero(upper >= best[-1][1])
            else:
                rest = np.flatnonzero(estimate > -np.inf)
            for vec_id, score in self._best(rest, query, k):
                yield own, vec_id, score

    def _best(self, at: np.ndarray, query: np.ndarray, k: int) -> list[tuple[int, float]]:
        scores = cosines(scaled(self.vectors[at].astype(np.float64)), query)
        if not self.repeated and len(at) > 64 * k:  # ties with the k-th stay
            least = -np.partition(-scores, k - 1)[k - 1]
            at, scores = at[scores >= least], scores[scores >= least]
        order = np.lexsort((self.ids[at], -scores))
        best: dict[int, float] = {}
        for i in order.tolist():
            best.setdefault(int(self.ids[at[i]]), float(scores[i]))
            if len(best) == k:
                break
        return list(best.items())


def _blocked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by block and length, candidates before queries."""
    now, block, parts, waiting = None, None, [], []

    def asked() -> Iterator[pa.RecordBatch]:
        ids, queries = (np.concatenate(x) for x in zip(*waiting, strict=True))
        step = max(1, CELLS // max(1, len(block.ids)))
        for at in range(0, len(ids), step):
            rows = list(block.nearest(ids[at : at + step], queries[at : at + step], k))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    for batch in batches:
        if not batch.num_rows:
            continue
        part, dims, kind, ids = (batch.column(i).to_numpy() for i in range(4))
        cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(dims) != 0) | (np.diff(kind) != 0)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            key = (part[begin], dims[begin])
            if key != now:
                if waiting:
                    yield from asked()
                now, block, parts, waiting = key, None, [], []
            rows = (ids[begin:end], batch.column(4).slice(begin, end - begin).flatten().to_numpy().reshape(end - begin, -1))
            if kind[begin] == 0:
                parts.append(rows)
                continue
            if block is None and parts:
                block, parts = Block(*[np.concatenate(x) for x in zip(*parts, strict=True)]), []
            if block is not None:
                waiting.append(rows)
                if sum(len(w[0]) for w in waiting) * len(block.ids) > CELLS:
                    yield from asked()
                    waiting = []
    if waiting:
        yield from asked()


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``k`` nearest of every row whose id ``every`` divides, among all rows."""
    spark = vectors.sparkSession
    entry = vectors.schema[vector_col].dataType.elementType.simpleString()
    kept = "float" if entry == "float" else "double"
    v = quoted(vector_col).cast(f"array<{kept}>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    found = vectors.where(quoted(vector_col).isNotNull() & quoted(id_col).isNotNull() & fine).select(quoted(id_col).cast("long").alias("id"), F.size(v).alias("dims"), v.alias("v"))
    size = found.agg(F.sum(F.col("dims").cast("long")) * (4 if kept == "float" else 8)).first()[0] or 0
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))
    candidates = found.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "dims", F.lit(0).alias("kind"), "id", "v")
    queries = found.where(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "dims", F.lit(1).alias("kind"), "id", "v")
    dealt = candidates.union(queries).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "dims", "kind")
    best = dealt.mapInArrow(lambda batches: _blocked(batches, k), "query_id long, vec_id long, score double")
    by_query = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.select("query_id", F.row_number().over(by_query).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
