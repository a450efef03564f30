"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the folder of
spark.checkpoint.dir and reads it again as the next stage's docs, and deletes what is read no more. All but the last return
the columns of documents, whatever further ones there are.

Defined results: null texts count as empty in every stage: they are not toxic where empty texts are not, equal to each other and to
empty ones, so that one of them stays, near nothing, of size 0, so that the mix takes none; null doc_ids teach nothing and lose to others
where one of a group stays; rows that repeat an id are documents of their own; texts are read whole, however long; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from astrolabe.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from astrolabe.llm.common import scope, staged

#: The stage's own similarity; that of op9 is near_dedup.PERCENT.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, of five-word similarity 0.8 or more, one row stays."""
    return near_dedup.drop_near_duplicates(docs, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Scoring by a learned grammar, sketches and a tokeniser cannot be written in SQL; tests/llm compares the
#: stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope(spark):  # holds what a stage hands to the next; the last one's rows outlive it
        for name, stage in STAGES:
            with scope(spark):
                docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=2 if name == STAGES[-1][0] else 1)
    return docs
