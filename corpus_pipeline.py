"""A corpus pipeline of five of the training-data operators, each stage over all that the one before kept.

Stages but the last keep all columns, whatever their names. Null and empty texts stay (near duplicates and repeated strings concern texts with words or bytes, packing gives them an end);
a very long text is one row like others, cut by packing alone; rows that repeat are near duplicates of each other, of which one stays. Null ids are kept, after all others where ids
are ordered. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import jaccard, mixing, packing, suffix_dedup, toxicity
from corpusloom.llm.common import discard, materialise, read, tune


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    tune(spark)
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id: five words, 0.8."""
    tune(spark)
    return jaccard.drop_near_duplicates(docs, words=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of long repeated strings go, and documents of which nothing is left."""
    tune(spark)
    return suffix_dedup.drop_repeats(docs, length_column="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    tune(spark)
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    tune(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: The tokenizer and the learned model have no SQL form; tests hold the stages against plain versions, and run() against what the stages keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:  # nothing reads the table of the stage before any more
            discard(before)
        before = docs
    return docs
