"""The corpus pipeline: each stage works on all that the one before it kept.

Stages take and keep rows, whatever their ids: null, repeated and clashing ones do no harm, and columns of any name pass.
An empty table passes through all stages as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, mixing, near_dedup, quality, sentencepiece_bpe
from quarry.llm.common import discard, materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are judged like others; without labels none stays."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; null, empty and blank ones are one group."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more. Those without words stay."""
    return near_dedup.drop_near_copies(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target weights; a document that several passes take has a row for each, one that none takes has none."""
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of each row; every row is decoded again and compared. No text, no tokens."""
    rows = sentencepiece_bpe.encode(docs, ["doc_id", "source", "text"], decoded=True)
    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.col("decoded") == F.replace(text, F.lit(sentencepiece_bpe.SPACE), F.lit(" "))
    return rows.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality", classify), ("exact_dedup", dedup), ("near_dedup", near), ("mixing", mix), ("sentencepiece", tokenize)]

#: Stages 1, 3 and 4 train, sketch and permute, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again as the next one's documents."""
    docs, former = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if former is not None:
            discard(former)
        former = docs
    return STAGES[-1][1](spark, docs, sf_dir)
