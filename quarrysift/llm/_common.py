"""What the operators of this folder share: word rules, batch sizes, labelled samples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrysift.operators.prefix import hash_key
from quarrysift.scratch import Scratch, shared_folder  # noqa: F401
from quarrysift.session import share_code

#: ASCII white space; a word is a maximal run of other characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def without_spaces(text: Column) -> Column:
    """The text without ASCII white space. Plain byte searches, several times as fast as a pattern."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP, -1))


# ---- batches and labelled samples -------------------------------------------------------------------------------------

_UNITS = {"": 1, "b": 1, "k": 2**10, "kb": 2**10, "m": 2**20, "mb": 2**20, "g": 2**30, "gb": 2**30}
#: Arrow batches have at most so many bytes and rows.
BATCH_BYTES, BATCH_ROWS = 8 * 2**20, 4000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, so that a batch of very long texts still fits a Python worker; which can import this package.

    Settings of the session are lowered to these bounds, never raised, so that no operator undoes what another one needs.
    """
    share_code(spark)
    bytes_, rows = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
    number = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", spark.conf.get(bytes_).lower())
    now = int(number[1]) * _UNITS.get(number[2], 2**30) if number else -1
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(bytes_, str(BATCH_BYTES))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, most: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id string, label int, text binary) of at most `most` labelled documents for which usable holds, drawn by a hash of the id;
    of all of them if `most` is None.

    Ids can be of any type; null ids have no label. Of several labels of one id the largest counts, of several texts the one
    with the least hash, so the bound holds for rows and their order of drawing is the same on every run. Labels other than
    0 and 1 are no labels; a null text is empty; an empty table gives no rows; extra columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    few = labels.where(usable & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    if most is not None:
        few = F.broadcast(few.orderBy(hash_key(F.col("id")), "id").limit(most))  # ids and labels of at most `most` rows
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(few, "id")
    once = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return once.select(F.col("id").cast("string").alias("id"), "label", F.col("text").cast("binary").alias("text"))
