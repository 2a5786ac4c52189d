"""Documents to encoded training text in five stages.

Every stage reads what its predecessor kept, as Parquet, and all but the last
return the columns of ``documents``. The folders of earlier stages are removed
once the last one is written, and all of them if a stage fails.

Cases: null texts count as empty and fail the quality rules; rows with a null id
give way to near duplicates with an id, and one row stays of a group without
ids; a leaking text is dropped alone, not with other rows under its id; of tied
rows (same id and text) the first by the other columns stays; very long texts go
through whole; an empty table stays empty; extra columns pass through, whatever
their names and types, nested ones too.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm import pieces, secrets
from gridlark.llm.common import free_name, quoted, shared_folder
from gridlark.llm.decontaminate import decontaminate
from gridlark.llm.quality import kept_documents
from gridlark.llm.queries import table
from gridlark.llm.simhash import grouped


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps."""
    return kept_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id, or of a group without ids the one with the smallest text hash.

    Rows are told apart by id and text, so different texts under one id each
    stand for their own group; of rows with the same id and text the first by
    those of their other columns that have an order stays. Repeated rows meet
    in the tasks that read them first, so one row of each is shuffled by a task.
    """
    tid, row, order, key = (free_name(docs, n) for n in ("text_hash", "whole_row", "row_order", "row_key"))
    found = grouped(docs.select("doc_id", F.xxhash64("text").alias(tid), "text"), ["doc_id", tid])
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col(tid).alias("text"))).alias("lead")
    leads = found.groupBy("root").agg(lead).select(_row_key(F.col("lead.id"), F.col("lead.text")).alias(key))
    plain = [quoted(f.name) for f in docs.schema if f.name != "doc_id" and _ordered(f.dataType)]
    whole = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    keyed = docs.select(_row_key(F.col("doc_id"), F.xxhash64("text")).alias(key), whole.alias(row), F.struct(*[c.alias(f"c{i}") for i, c in enumerate(plain)]).alias(order))
    one = keyed.groupBy(key).agg(F.min_by(row, order).alias(row)).join(leads, key)  # one key for both, so the texts are shuffled once
    return one.select(*[F.col(row)[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def _ordered(kind: T.DataType) -> bool:
    """Whether values of a type can be compared: not if a map or a variant stands in it, at any depth."""
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind)
    return _ordered(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def _row_key(doc_id: Column, text_hash: Column) -> Column:
    """One text for an id, or none, and a text's hash."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text_hash.cast("string"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and ``n_chars`` brought up to date."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", _length(F.col("text"), docs)) if "n_chars" in docs.columns else clean


def _length(text: Column, docs: DataFrame) -> Column:
    return F.length(text).cast(docs.schema["n_chars"].dataType)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids (comma-joined), decoded text and digests of both for each document, beside its other columns."""
    kept = [c for c in docs.columns if c in ("doc_id", "lang", "source")]
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), kept, digest=False)
    return coded.select("*", *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "decoded")])


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret redaction", secrets_stage),
    ("piece encoding", encode_stage),
]

#: XXH64, SimHash and BPE are beyond DuckDB's SQL; tests/llm holds the rows against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    stale = [at]
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
        stale = [f"{at}/{k}" for k in range(len(STAGES) - 1)]
    finally:
        for folder in stale:
            remove(spark, folder)
    return docs


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this run in the shared file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
