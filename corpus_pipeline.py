"""A training-data pipeline over documents: quality rules, exact dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrysift.llm import exact_dedup, mixing, near_dedup, packing, quality_rules, tokens
from quarrysift.llm._common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others go on with their cleaned text.

    Null and empty texts are rejected; repeated rows stay repeated; nulls in other columns stay.
    """
    return quality_rules.filter_documents(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: of rows that repeat an id and its text one, of ties the smallest id.

    Null counts as empty, so one row without text stays.
    """
    return exact_dedup.drop_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: documents are repeated, cut or left out.

    A null source is a source of its own; documents without a word go; of a document's rows the shortened one is its last epoch.
    """
    return mixing.mixed_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, a similarity of 0.8 or more, the smallest id.

    Rows without an id or without a word stay; of rows that repeat an id all stay or go.
    """
    return near_dedup.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every row in sequences of 4096 tokens: doc_id, epoch, piece, start, length, ids_crc32,
    sequence_id, offset.

    epoch numbers the rows of one doc_id from 0, whole texts before the shortened one, so (doc_id, epoch, piece) is unique.
    Null texts are empty; rows without an id are numbered by their text.
    """
    import public_tokenizers

    sized = docs.select("doc_id", "text", F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.xxhash64("text").alias("digest"))
    pieces = tokens.tokenize_pieces(sized, public_tokenizers.path("word_bpe_49k.json"), more=("chars", "digest")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    same = Window.partitionBy("doc_id", "piece", F.when(F.col("doc_id").isNull(), F.col("digest"))).orderBy(F.desc("chars"), "digest")
    numbered = pieces.select("doc_id", (F.row_number().over(same) - 1).alias("epoch"), "piece", "start", "length", "ids_crc32")
    pieces = Scratch(spark).keep(numbered, "pieces")
    return packing.best_fit_pack(pieces, key_cols=("doc_id", "epoch", "piece"))


STAGES = [("quality_rules", quality), ("exact_dedup", copies), ("near_dedup", near), ("mixing", mix), ("packing", pack)]
#: MinHash and tokenizers can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads what the one before has written."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
