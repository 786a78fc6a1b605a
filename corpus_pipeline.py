"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents.

All stages but the last hand on every column of ``documents``, whatever its name. A null text counts as empty, ids may repeat or
be null, and an empty table goes through every stage as such; each stage says below what that means for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, quality_crf, simhash, toxicity_mil, transducer_bpe
from tidemark.llm.queries import table, tokenizer_path
from tidemark.llm.shared import discard, new_folder, passing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Texts without words score as such training documents do; repeated rows share their fate."""
    return quality_crf.keep_good(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go, as long as they may be; those without words are one sentence without a mark."""
    return toxicity_mil.keep_clean(docs, toxicity_mil.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest id, whatever ids repeat or are null. Texts without words are one group."""
    return simhash.one_of_each_component(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, at most twice; those without words go. A null source is a source."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ids, their count and digests of each row; a document that the mix repeats has as many rows, an empty text no ids."""
    return transducer_bpe.encode_digest(docs, tokenizer_path(), with_ids=True)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: Trained models, hashes and pivotal steps are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote for itself goes when its output is written, and that output when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with passing() as kept:
            kept.append(new_folder(spark, f"pipeline-{name}"))
            out = stage(spark, docs, sf_dir)
            out.write.parquet(kept[0])
            docs = spark.read.schema(out.schema).parquet(kept[0])
        discard(before)
        before = kept
    return docs
