"""Readers and sinks: whole text files with their path as metadata, JSON properties, idempotent reload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, project, stage, kind, file, text) of every text file below ``project_stage/kind/file`` folders."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    parts = F.split("path", "/")
    top = F.element_at(parts, -3)
    return rows.select(
        "path",
        F.regexp_extract(top, r"^(.*?)(?:_([^_]*))?$", 1).alias("project"),
        F.regexp_extract(top, r"^(.*?)(?:_([^_]*))?$", 2).alias("stage"),
        F.element_at(parts, -2).alias("kind"),
        F.element_at(parts, -1).alias("file"),
        "text",
    )


def json_property(column: Column, name: str, kind: str) -> Column:
    """One property of a JSON text; null where the text or the property is not as expected."""
    return F.from_json(column, f"`{name}` {kind}")[name]


def visible_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags go, white space becomes single spaces."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))


def new_rows(incoming: DataFrame, stored: DataFrame, text: str) -> DataFrame:
    """Rows of ``incoming`` whose checksum is not ``stored`` yet, once each; rows without a text are left out, not taken for empty ones."""
    marked = incoming.where(F.col(text).isNotNull()).withColumn("checksum", F.md5(F.col(text).cast("binary")))
    return marked.join(stored.select("checksum"), "checksum", "left_anti").dropDuplicates(["checksum"])
