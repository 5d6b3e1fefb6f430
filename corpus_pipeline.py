"""A corpus pipeline: quality rules, line dedup, near duplicates, mixing and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's
result to the shared folder and reads it again as the next one's documents.  All but the
last stage return the columns of ``documents``.

In every stage null ids and repeated rows are rows like others, an empty table stays empty, and further columns
pass through under any name (the last stage leaves them).  Null, empty and blank texts are rejected by the
quality rules; handed to the later stages they stay as they are, linked with nothing and without tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import jaccard_join, line_dedup, mixing, piece_coding, quality_rules
from shelfcast.llm.tables import free_name, table
from shelfcast.session import materialise

#: Shares of tokens the mixture aims at.
WEIGHTS = {"clean": 0.94, "poor": 0.01, "toxic": 0.05}


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat passages seen before; texts left without a word go."""
    out = free_name(docs, "_cut")
    cut = line_dedup.dedup_lines(docs, out=out)
    removed = F.size(F.col(out)["removed"]) > 0
    emptied = removed & ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    changed = F.when(removed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~emptied).withColumn("n_chars", changed).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    return jaccard_join.keep_one(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say; clean ones at least once."""
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    out = free_name(docs, "mixing")
    return mixing.realise(mixing.mix(docs, labels, WEIGHTS, keep=("clean",), out=out), out)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return piece_coding.encode_texts(docs, piece_coding.load_vocabulary())


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_repeats),
    ("near duplicates", one_of_each),
    ("mixing", mixed),
    ("piece coding", encoded),
]

#: SQL can't express near duplicates over groups, the fitted rates or the coding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
