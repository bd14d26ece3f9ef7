"""From raw documents to packed training sequences: five stages, each on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm import decontam, jaccard_join, language_id, packing, suffix_dedup
from threadloom.llm.common import in_fold, kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: rejected are those without a letter, and those where no language
    has more than `least` of the probability.

    A null or empty text has no letter and goes; a null lang, source or n_chars stays as it is; a null doc_id is
    learned from and kept like any other; repeated rows get the same answer; of equal probabilities the
    first language in alphabetical order counts; texts are read whole; columns beside those of documents are
    dropped, whatever their names; an empty table gives none.
    """
    least = 0.3
    net = language_id.train(docs.filter(~in_fold(F.col("doc_id"), 4, 2)))
    return language_id.identify(docs.select(COLUMNS), net).filter(
        (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") > least)).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles, the one with the smallest id.

    Texts without words (null, empty, blank) link with nothing and all stay; a row that repeats with its id stays
    once; a row without an id stays if it is linked to no row with one; fewer than five words are one shingle;
    other columns are dropped; an empty table gives none.
    """
    return jaccard_join.one_per_component(docs.select(COLUMNS), 5, 80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes that occur more than once; documents of which nothing is left go.

    A null or empty text has no such string and stays as it is; of repeated rows each loses what repeats, so
    long equal texts go altogether; n_chars is counted anew where something was cut; other columns and null ids are
    kept; an empty table gives none.
    """
    others = ("lang", "source", "n_chars")
    done = suffix_dedup.remove_repeats(docs, 400, carry=others)
    cut = F.col("n_removed") > 0
    return done.filter(~cut | (F.trim("kept_text") != "")).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source",
        F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item, edited or not.

    A null or empty text holds none and stays; rows that share an id with a leaking row go with it (a null id counts
    as one id); null items are ignored; other columns are dropped; an empty table, or an empty benchmark, changes nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = kept(decontam.find_leaks(docs, items), "leaks")
    return decontam.clean_documents(docs.select(COLUMNS), leaks)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048.

    A null or empty text is its end token alone; repeated rows and null ids are packed as documents of their own; ties of
    length are settled by id, then text; an empty table gives no sequence.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text_key")


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_leaks),
    ("packing", packed),
]

#: SQL can express neither the network nor the tokens; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
