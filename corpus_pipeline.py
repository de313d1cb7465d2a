"""Corpus pipeline: quality, near duplicates, repeated passages, test items, tokens.

Each stage takes the documents its predecessor kept and returns those it
keeps, with the columns of ``documents``; the last adds the token columns.
Empty tables give empty tables.
Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvid.llm import blocks, bpe, decontamination, jaccard, quality, substring
from korvid.sources.storage import new_folder

#: Documents of a lower score go.  Half is where the calibrated curve calls a text as likely bad as good.
KEEP_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject; it learns from the labelled ones among them.

    A null or empty text has the classifier's neutral score, which it takes
    from all labelled rows; repeated rows stay or go together.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model, KEEP_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that similar shingle sets link.

    Of rows with one id, equal ones are one document and stay once; rows whose
    texts differ are all parts of the document that the id names and stay.
    Null, empty and blank texts, and rows without an id, link with nothing and
    stay as they are.
    """
    groups = jaccard.join(docs).where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_korvid_gone")).distinct()
    left = docs.join(groups, F.col("doc_id") == F.col("_korvid_gone"), "left_anti").select(docs.columns)
    twice = left.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_korvid_twice"))
    twice = blocks.cut(twice)
    if twice.isEmpty():
        return left
    again = F.col("doc_id") == F.col("_korvid_twice")
    return left.join(twice, again, "left_anti").unionByName(left.join(twice, again, "left_semi").distinct())


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document of a smaller id keeps; n_chars is counted again.

    Null texts stay null; rows with one id lose nothing to each other.  Only
    the text goes through the operator, with the other columns as one struct,
    so columns named like its results keep their values.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = substring.dedup(docs.select("doc_id", "text", F.struct(*others).alias("_korvid_row")))
    left = left.select("doc_id", "text", *(F.col(f"_korvid_row.`{c}`").alias(c) for c in others))
    if "n_chars" in others:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy, edited or not, of a test item.

    Null and empty texts hold none and stay; repeated rows stay or go together.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, all columns, with n_tokens, ids, and the digests of ids and decoded text.

    A null or empty text has no tokens; repeated rows stay and are encoded
    alike; input columns named like the added ones are replaced.
    """
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", repeated_passage_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE encoding and decoding", token_stage),
]

#: Not expressible in SQL: classifier, chunking, alignment and tokens are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read by the next."""
    docs = blocks.documents(spark, sf_dir)
    base = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
