"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

run() writes the result of each stage to the shared folder as Parquet and reads it as the next stage's docs.
All stages but the last return the columns of documents.

Defined results: a null text counts as empty in each stage; empty texts aren't toxic, are one group of exact copies, are
linked with nothing, and have no words for the mix, so they end there; texts are read whole however long they are; of
rows that repeat id and text one stays; a null id comes after every id; a null source is the last source; empty tables
give empty results; other columns are carried along whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curalake.llm.bpe import round_trip_digests
from curalake.llm.common import discard, saved, table
from curalake.llm.exact_dedup import drop_exact_duplicates
from curalake.llm.mixing import mix
from curalake.llm.near_dedup import drop_near_duplicates
from curalake.llm.queries import tokenizer_file
from curalake.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8 or more), the one with the smallest id stays."""
    return drop_near_duplicates(docs, k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the shares of their weights; documents come again, or are cut, as the mix takes them."""
    return mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of each document, as digests."""
    return round_trip_digests(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The stages learn, decode characters and find components; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = None
    for name, stage in STAGES:
        kept = saved(stage(spark, table(spark, sf_dir, "documents") if docs is None else docs, sf_dir), f"stage-{name}")
        if docs is not None:
            discard(docs)
        docs = kept
    return docs
