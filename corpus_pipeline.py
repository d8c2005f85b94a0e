"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the docs
of the next. All but the last return the columns of documents.

Defined results of every stage: an empty table gives an empty one; extra columns, whatever their names, are kept (packing
returns its own); very long texts are read whole; repeated rows are judged each. What else a stage does with null ids, null
and empty texts and ties stands at the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import _graph, minhash, packing, quality_gam, secrets, suffix_dedup


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, fitted on a bounded sample of labels, doesn't reject.

    Null and empty texts are scored like any (all statistics 0); null ids don't matter; a score of exactly 0.5 is kept.
    """
    return quality_gam.keep_good(docs, quality_gam.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Rows with a null id or without words (null, empty, blank texts) are copies of nothing and stay; rows that share an id
    count as one document and stay or go together.
    """
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that also start earlier; a document of which nothing is left stays, empty.

    Null texts become empty ones; rows with a null id are kept as they are; of equal strings the one in the smallest id, then
    at the first place, stays; half a code point at a cut is dropped.
    """
    return _counted(suffix_dedup.deduplicate(docs))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark.

    Null texts stay null, empty ones empty; null ids don't matter; spans that overlap are replaced by one mark.
    """
    return _counted(secrets.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    A null or empty text is one separator id; a null id is carried through; repeated rows are packed each.
    """
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_bytes", repeated_bytes), ("secrets", secret_spans), ("packing", packed)]

#: Learned models and the tokenizer aren't expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Results between stages go to the folder that spark.checkpoint.dir names.

    Once a stage is written, the tables that it was made with are deleted, its input among them; the last result stays.
    """
    folder = _graph.folder(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}-{name}"
        with _graph.scratch(spark) as done:
            stage(spark, docs, sf_dir).write.parquet(path)
            done.extend([before] if before else [])
        docs, before = spark.read.parquet(path), path
    return docs
