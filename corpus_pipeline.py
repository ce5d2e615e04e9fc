"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark contamination, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the stage before has kept; all but the last
return the columns of documents. A stage's result is written in the shared folder and read again, so a lost executor
costs one stage's tasks and no lineage runs over a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadspark.components import scratch
from leadspark.llm import bpe, decontaminate, minhash, suffix_dedup, toxicity
from leadspark.llm.common import crc_bucket, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.5 or more.

    Null and empty texts have no match and stay; without labels of both kinds all stay; repeated rows go or stay together.
    """
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 5) != 0))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least document of each class at a similarity of 0.8 on five-word shingles.

    Texts without words and rows of a null id stay; rows of one id are one document and stay or go together.
    """
    return minhash.representatives(docs, size=5, least=80, slots=5)


def passage_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 100 bytes or more that an earlier place of the corpus holds.

    No row goes, and a text that is all repeated becomes empty, as do null texts; a null id comes before all others.
    """
    return suffix_dedup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more stand in benchmark windows.

    Texts without words stay; an empty benchmark drops none; items without an id count too.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the remaining texts and decodes them again: a row for each row, null and empty texts with no tokens."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("passage_dedup", passage_dedup_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: Several stages can't be told in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go when its result is there
            docs = written(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
