"""A corpus pipeline from operators of arborwell.llm: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborwell.llm import common, mixing, packing, quality, secret_scan, simhash


#: What the last stage staged, by folder: the next stage deletes it, once the output has been written.
_SCRATCH: dict[str, list] = {}


def _alone(step):
    """A stage that first deletes what the one before it staged, unless its docs still read that."""

    @functools.wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop_staged(_SCRATCH.pop(sf_dir, []), docs)
        mark = len(common.staged_since(0))
        out = step(spark, docs, sf_dir)
        _SCRATCH[sf_dir] = common.staged_since(mark)
        return out

    return run_step


@_alone
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any other, and go or stay together; repeated rows share a score; an empty table stays empty.
    """
    labels = common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    return quality.keep_good(docs, "doc_id", "text", labels)


@_alone
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8) stays: the smallest doc_id.

    Null and empty texts are one group; of rows that repeat whole one stays; a null doc_id stays only in a group without others.
    """
    return simhash.keep_one(docs, "doc_id", "text")


@_alone
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows. Null texts stay null, with their n_chars; every row stays."""
    clean = secret_scan.redact(docs, "text")
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean


@_alone
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it.

    Null and wordless texts are never taken; null sources are one source; repeated rows are documents of their own.
    """
    return mixing.mix(docs, "doc_id", "text", "source")


@_alone
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences. Null texts count as empty; repeated rows are documents of their own."""
    return packing.pack(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_stage), ("near_duplicates", dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
