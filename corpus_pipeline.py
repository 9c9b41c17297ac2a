"""Five stages from raw documents to encoded ones, each written and read again.

quality classifier -> SimHash near-duplicates -> substring deduplication -> benchmark
decontamination -> BPE encoding and decoding. All but the last stage return the columns of
documents; the last returns digests of every document that is left. A stage's folder goes
once the stage after it is written.

Defined cases: documents with null or empty texts are judged like others by the first stage
and pass all later ones; rows with a null doc_id are documents of their own; repeated rows
are near-duplicates, of which one stays; a text that is a copy as a whole goes in the third
stage; columns beyond those of documents, clashing names included, come through to the last
stage; empty tables give no rows in any stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import base, bpe, decontaminate, quality, simhash, substring
from corpusloom.storage import forget, written

#: A document is rejected if label 1 is less likely than this.
QUALITY_THRESHOLD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject(docs, base.table(spark, sf_dir, "labels"), ~base.held_out("doc_id", 5, 0), QUALITY_THRESHOLD)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, bits=4, shingle=4, seed=42)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.cut(docs, min_words=50, line_words=25)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, base.table(spark, sf_dir, "benchmark"), size=13, share=20)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: No SQL engine has the fingerprints' hash, the classifier or the vocabulary; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
