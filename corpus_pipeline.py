"""The corpus pipeline: quality rules, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All but the last return
the columns of docs, further ones included. Null texts count as empty, so the quality rules reject them;
of rows that repeat a text, and of near copies, the one with the smallest doc_id stays (without any doc_id, one of them);
two passages that tie are told apart by doc_id, then text; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import near_copies, packing, quality_rules, suffix_dedup
from terravane.llm.common import stored, swept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity from 0.8) the smallest doc_id stays.

    Candidates come from SimHash fingerprints by vantage-point trees, and from bands of minima for what those can't reach.
    """
    return near_copies.keep_first(docs, width=5, least=0.8)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes within 100-byte strings that also start earlier are cut out; n_chars follows the text.

    A character that is only partly within stays whole; documents of which nothing is left go.
    """
    return suffix_dedup.strip(docs, threshold=100).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048: one row per piece of a document, with its token ids, sequence and offset."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end=0)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("suffix-array dedup", passages), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what each but the last returns is written as Parquet and read again.

    Scratch that a stage has made goes once its result is written; the last stage's stays for whoever reads the result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with swept(spark):
            docs = stored(stage(spark, docs, sf_dir), "pipeline-" + "".join(c if c.isalnum() else "-" for c in name), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Rule votes, fingerprints, repeats of bytes and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
