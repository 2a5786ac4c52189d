"""Helpers that the corpus operators share.

Row shape: every operator selects the columns it needs by name before doing
anything else, so extra columns of any name pass by it untouched.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}

#: Sides above this many rows are joined by shuffle instead of by broadcast.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and everything runs in one process.

    A cluster without that setting is an error: executors would write to disks that the others can't read.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (sc.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/gridlark-{sc.applicationId}"


def quoted(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first longer form of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when a count proves it small; else leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def plain_words(text: Column) -> Column:
    """Lower-cased runs of digits, letters and everything beyond ASCII; null gives no words.

    The Kelvin sign is the one character beyond ASCII that would fall to a
    plain ASCII letter alone, so it is moved out of the way first.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def map_texts(
    docs: DataFrame,
    fn: Callable[[list[str | None]], list[tuple]],
    schema: str,
    keep: list[str] | None = None,
    text_col: str = "text",
) -> DataFrame:
    """Run ``fn`` over slices of texts in Arrow batches and put its columns beside ``keep``.

    ``fn`` takes a list of texts (None for null) and returns one tuple for each,
    in the order of ``schema`` (a DDL string without the kept columns).
    """
    keep = ["doc_id"] if keep is None else keep
    own = [quoted(c) for c in keep]
    full = T.StructType([*docs.select(*own).schema, *T.StructType.fromDDL(schema)])  # kept columns may hold fields of any name
    names, kinds = zip(*(c.split() for c in schema.split(",")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = fn(batch.column(len(keep)).to_pylist())
                made = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(len(keep))]
                    + [pa.array(list(c), ARROW[k]) for c, k in zip(made, kinds, strict=True)],
                    names=[*keep, *names],
                )

    plain = [c.alias(f"c{i}") for i, c in enumerate(own)]  # mapInArrow looks its columns up by name
    return docs.select(*plain, quoted(text_col).cast("string").alias("text")).mapInArrow(run, full)
