"""Incremental intake: event-time windows, an upsert guarded by coverage, and requests for what is missing.

``hourly`` is one definition for tables and for streams; on a stream the
watermark bounds the state and lets finished windows go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gridlark.operators.scans import gaps, merged
from gridlark.operators.series import guarded_replace


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each event type by hour of ``ts``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    sums = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """(key, began, ended, n, total) of each session: events of one key with less than ``gap`` between them; it ends with the last event and the gap.

    One definition for tables and for streams, where the watermark closes sessions.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    sums = rows.where("ts IS NOT NULL").groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n", "total")


def guarded_upsert(coverage: DataFrame, folder: str) -> DataStreamWriter:
    """Writes a stream of (key, coverage) so that no batch lowers a stored coverage by more than the slack.

    Every batch writes a new version of the table under ``folder/<batch>``,
    from the version of the batch before, so a batch that is run again after a
    failure gives the same version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("key").agg(F.max("coverage").alias("coverage"))
        if number:
            old = batch.sparkSession.read.parquet(f"{folder}/{number - 1}")
            new = guarded_replace(old, new, "key").select("key", "coverage")
        new.write.mode("overwrite").parquet(f"{folder}/{number}")

    return coverage.writeStream.foreachBatch(merge)


def missing_requests(wanted: DataFrame, keys: list[str], start: str, end: str, held: Callable[[SparkSession], DataFrame], folder: str) -> DataStreamWriter:
    """Writes, for a stream of wanted spans (keys, start, end), the parts that neither ``held`` has nor an earlier batch asked for.

    ``held`` reads the table of fetched spans as it is when a batch runs.
    Requests stand under ``folder/batch=<number>``; a batch looks at those of
    smaller numbers only, so one that is run again after a failure asks for the
    same, and a query that is restarted goes on where it ended.
    """

    def ask(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = held(spark).select(*keys, start, end)
        if number:
            known = known.unionByName(spark.read.parquet(folder).where(f"batch < {number}").select(*keys, start, end))
        left = gaps(merged(known, keys, start, end), keys, start, end, merged(batch, keys, start, end))
        left.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return wanted.writeStream.foreachBatch(ask)
