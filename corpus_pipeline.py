"""Corpus pipeline: language ID, near-duplicate removal, decontamination, surrogates for personal data, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns a DataFrame; all but the last return the columns of docs, in
whatever number and under whatever names. What depends on a text alone is
decided where its row is, without a join, so it holds for rows that repeat a
doc_id or have none; a row without a doc_id is in no group of near duplicates.
Empty tables give empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom.llm import bpe, decontaminate, jaccard, langid, pii
from spikeloom.llm.graph import shared_folder, told_apart, written


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and everything else as one struct, so that a decision on a text travels with its row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"), F.lit(None).cast("int").alias("_none" + "_" * max(map(len, docs.columns)))).alias("rest"))


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, or no letter) go."""
    return _back(langid.identify(_carried(docs), langid.train(docs), carry=True).where("lang_pred <> 'und'"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five words, similarity 0.8) the one with the smallest doc_id stays; each text of a repeated id is judged by itself."""
    apart = told_apart(docs)
    rows, own = (written(apart[0]), "_new") if apart else (docs, "doc_id")
    copies = jaccard.jaccard_components(rows.select(F.col(own).alias("doc_id"), "text"), 5, 80).where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    return rows.join(copies, own, "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or all of a shorter one) go."""
    found = decontaminate.decontaminate(_carried(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, carry=True)
    return _back(found.where("not contaminated"), docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates; n_chars follows the new text."""
    new = pii.replace_pii(docs)
    put = {"doc_id": F.col("doc_id"), "text": F.col("new_text"), "n_chars": F.when(F.col("n_entities") > 0, F.length("new_text").cast("long")).otherwise(F.col("rest.n_chars")) if "n_chars" in docs.columns else None}
    return new.select(*(put[c].alias(c) if put.get(c) is not None else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every text, with digests of the ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("pii_surrogates", pii_stage), ("byte_bpe", token_stage)]

#: Learned models and byte-pair merges are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
