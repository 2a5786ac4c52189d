"""SimHash near-duplicate groups through a covering family of bit masks.

Fingerprints are 64-bit SimHashes of four-word shingles. Two fingerprints link
when at most ``radius`` bits differ. Candidates come from a covering
locality-sensitive hash: every bit position gets a non-zero vector of
``radius + 1`` bits, and table ``v`` keeps the positions whose vector has an odd
inner product with ``v``. The at most ``radius`` vectors of a pair's differing
positions leave some non-zero ``v`` orthogonal to all of them, so in that
table both keys agree: no link is missed, whatever the data.

Scale. Exact copies collapse to one fingerprint before any table is built. The
size of each bucket is counted first (a sum that combines before the shuffle).
Small buckets are compared in the JVM as bounded arrays; a large bucket is
cut into salted chunks and every pair of chunks becomes a group of its own,
which returns a spanning forest of its links rather than all pairs. Components
come from min-label rounds with pointer jumping on distinct fingerprints. Hubs,
the root of a giant component, a crowded bucket and a fingerprint that a third
of all rows share are keys whose rows stay where they are and meet a bounded
broadcast; all other keys meet by shuffle.

Cases: null and empty texts have fingerprint zero and link like any other; a
null id takes part in linking but never names a component unless no other id is
there; repeated rows share a component; a bit with as many hashes for as against
it is 0; very long texts are hashed whole; other columns, of any name, are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import checkpointed, map_texts
from gridlark.operators.components import HEAVY_ROWS, join_by_key

SHINGLE, SEED, BITS = 4, 42, 64
#: Buckets of up to this many fingerprints are compared as one array.
SMALL_BUCKET = 8
#: Fingerprints in one chunk of a large bucket.
CHUNK = 4096


def fingerprint(text: str | None) -> int:
    """The SimHash of one text as a signed 64-bit number."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower: A-Z alone
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: n - SHINGLE + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    lanes = np.array(hashes, np.uint64).astype(">u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(lanes), 1 << 14):
        part = lanes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(lanes)).view(">i8")[0])


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed 64-bit numbers; bit i has vector 1 + i mod (2^(radius+1) - 1)."""
    top = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, top + 1):
        mask = sum(1 << i for i in range(BITS) if ((1 + i % top) & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fps``.

    Every node is compared once with what no walk has reached yet, so a dense
    group costs little more than its size.
    """
    left = fps
    edges: list[tuple[int, int]] = []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            node = front.pop()
            near = np.bitwise_count((left ^ node).view(np.uint64)) <= radius  # of a negative number it would count the absolute value
            if near.any():
                found = left[near]
                edges += [(int(node), int(x)) for x in found]
                front += list(found)
                left = left[~near]
    return edges


def links(fps: DataFrame, radius: int = 4, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that connect all pairs within ``radius``.

    Small buckets give all their links; a chunk pair of a large bucket gives a
    spanning forest, which has the same components.
    """
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.k")
    shared = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = checkpointed(join_by_key(keyed, shared, ["t", "k"], fps.count() * len(masks), heavy_rows=heavy_rows))

    pair = F.expr(
        "filter(flatten(transform(fps, (a, i) -> transform(slice(fps, i + 2, size(fps)), b -> struct(a AS a, b AS b)))),"
        f" p -> bit_count(p.a ^ p.b) <= {radius})"
    )
    small = (
        members.where(F.col("n") <= SMALL_BUCKET)
        .groupBy("t", "k")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .select(F.explode(pair).alias("p"))
        .select("p.a", "p.b")
    )

    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    salted = (
        members.where(F.col("n") > SMALL_BUCKET)
        .withColumn("c", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("t", "k", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), "fp")
    )

    def connect(group: pd.DataFrame) -> pd.DataFrame:
        found = forest(np.sort(group["fp"].to_numpy(np.int64)), radius)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    large = salted.groupBy("t", "k", "lo", "hi").applyInPandas(connect, "a long, b long")
    return small.unionByName(large).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(fp, root, least) of the nodes with links: the least id (``least`` of ``nodes``, nulls last) that is reachable, and its node.

    A round sends each node's label to its neighbours, keeps the least, and
    then jumps to the label's own label, so long chains close in few rounds.
    Labels carry the id itself, so nothing is grouped by component afterwards.
    Each round is checkpointed in the shared folder.
    """
    least = F.col("least") if "least" in nodes.columns else F.lit(None).cast("long")
    own = nodes.select("fp", F.struct(least.isNull().alias("nameless"), least.alias("least"), F.col("fp").alias("root")).alias("label"))
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(own.join(both.select(F.col("a").alias("fp")).distinct(), "fp"))
    n_edges, n_nodes = both.count(), labels.count()
    for _ in range(max_rounds):
        heard = join_by_key(both, labels.withColumnRenamed("fp", "b"), "b", n_edges, heavy_rows=heavy_rows).groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("near"))
        nearer = labels.join(heard, "fp").select("fp", "label", F.least("label", "near").alias("next")).withColumn("at", F.col("next.root"))
        jump = labels.select(F.col("fp").alias("at"), F.col("label").alias("far"))
        jumped = join_by_key(nearer, jump, "at", n_nodes, "left", heavy_rows)
        moved = checkpointed(jumped.select("fp", F.least("next", F.coalesce("far", "next")).alias("label"), F.col("label").alias("was")))
        labels = moved.select("fp", "label")
        if moved.where("label.root <> was.root").limit(1).count() == 0:
            return labels.select("fp", "label.root", "label.least")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def fingerprints(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (the id) and ``fp`` of every row."""
    return map_texts(docs, lambda texts: [(fingerprint(t),) for t in texts], "fp long", keep, text_col)


def grouped(docs: DataFrame, keep: list[str], radius: int = 4, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The columns ``keep`` (with ``doc_id``) and ``fp`` of every row, its component's node ``root`` and smallest id ``component_id``."""
    fps = checkpointed(fingerprints(docs, keep))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(distinct, links(distinct.select("fp"), radius, heavy_rows), heavy_rows=heavy_rows).select("fp", "root", F.col("least").alias("first"))
    named = F.when(F.col("root").isNotNull(), F.col("first")).otherwise(F.col("least"))
    of = checkpointed(distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), named.alias("component_id")))
    return join_by_key(fps, of, "fp", fps.count(), heavy_rows=heavy_rows).select(*keep, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row per document: its fingerprint and the smallest id of its component."""
    return grouped(docs, ["doc_id"], radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
