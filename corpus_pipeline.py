"""A corpus from raw documents to token ids: bad text out, shared lines out, near copies out, benchmark text out, encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumery.llm import decontam, line_dedup, quality, sentencepieces, simhash
from plumery.llm.common import remove, table, written


def _as_documents(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` with n_chars made anew from the text."""
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in like.columns else docs
    return docs.select(*like.columns)


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without what the quality classifier, learned from this stage's own documents, scores below 0.3. Null and empty texts are scored
    like others; rows without an id are scored, never learned from; an empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least five documents share, which stay in the largest id alone. No row goes; a null text stays
    null where nothing is dropped; rows without an id neither count nor lose lines."""
    return _as_documents(line_dedup.dedup_lines(docs), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose five-word shingles have a similarity of 0.8 or more: that of the smallest id. Rows alike in
    id and text are one; rows without an id all stay; null and blank texts are one group."""
    return simhash.keep_one(docs)


def cut_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the stretches that the benchmark has as well. No row goes; null texts stay null."""
    return _as_documents(decontam.remove_contamination(docs, table(spark, sf_dir, "benchmark")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ids, n_pieces and lossless in place of text; null and empty texts have no ids."""
    return sentencepieces.encode_pieces(docs, sentencepieces.model_path()).drop("text")


STAGES = [
    ("quality_classifier", reject_bad),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", cut_benchmark_text),
    ("sentencepiece_encoding", encode),
]
#: Fingerprints, learned scores and segmentations have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's documents are removed when those of the next one are written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs, path = written(docs)
            if last:
                remove(spark, last)
            last = path
    return docs
