"""Connected components by rounds of least labels."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in spark.checkpoint.dir, or in a temporary folder where that is unset and everything runs in one process."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/gridlark-{sc.applicationId}")
    return df.checkpoint()


#: Keys with more rows than this, and more than one in 10,000 of all, are joined by broadcast.
HEAVY_ROWS, HEAVY_KEYS = 1_000_000, 10_000


def join_by_key(left: DataFrame, right: DataFrame, on: str | list[str], rows: int, how: str = "inner", heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``left`` (of ``rows`` rows) joined, "inner" or "left", with ``right``, which holds every key once.

    A key may hold a third of all rows. Keys with over ``rows / HEAVY_KEYS`` rows
    can't be more than HEAVY_KEYS, so their part of ``right`` is broadcast and
    their rows stay where they are; all others meet by shuffle. Where no key can
    have over ``heavy_rows`` rows it is a plain join. Null keys meet nothing.
    """
    keys = [on] if isinstance(on, str) else on
    if rows <= heavy_rows:
        return left.join(right, keys, how)
    heavy = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(heavy_rows, rows // HEAVY_KEYS)).select(*keys)
    hot = left.join(F.broadcast(heavy.join(right, keys, how)), keys)
    return hot.unionByName(left.join(F.broadcast(heavy), keys, "left_anti").join(right, keys, how))


def connected(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(id, root) of every row of ``nodes`` (id): the least id that edges (a, b) reach.

    In a round every node takes the least label around it and then that
    label's own label, so chains close in few rounds. Hubs, and the root under
    which a giant component gathers, don't make one task of their rows.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(nodes.select("id", F.col("id").alias("root")))
    n_edges, n_nodes = both.count(), labels.count()
    for _ in range(max_rounds):
        heard = join_by_key(both, labels.withColumnRenamed("id", "b"), "b", n_edges, heavy_rows=heavy_rows).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        nearer = labels.join(heard, "id", "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("root").alias("far"))
        jumped = join_by_key(nearer, jump, "next", n_nodes, "left", heavy_rows)
        moved = checkpointed(jumped.select("id", "root", F.least("next", F.coalesce("far", "next")).alias("new")))
        labels = moved.select("id", F.col("new").alias("root"))
        if moved.where("root <> new").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
