"""From raw documents to packed training sequences, stage by stage.

Each stage is one operator of ``slotwise.llm``. Its result is written as
Parquet in the shared folder and read again as the next stage's documents, so a
lost executor costs at most a part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise.llm import decontamination, minhash_dedup, packing, substring_dedup, toxicity
from slotwise.llm.tables import read, write_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, does not reject."""
    model = toxicity.learned(spark, docs, sf_dir)
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return minhash_dedup.near_duplicates(docs).where("first_row").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that occur elsewhere; the rest of each text stays as it is."""
    cut = substring_dedup.remove_repeats(docs, cut_text=True).withColumn("text", F.col("cut_text"))
    shorter = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", shorter).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to matter."""
    found = decontamination.contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    packed = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learned scores and token ids have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = write_out(stage(spark, docs, sf_dir))
    return docs
