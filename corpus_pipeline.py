"""A training-text pipeline over `documents`: five stages, each written as Parquet and read again by the next.

Toxic documents go, boilerplate lines are cut, one document of each near-duplicate group stays, personal data is masked, and what is left
is packed into sequences. Every stage works on all rows that the stage before it kept. The first four return the columns of
documents, with n_chars of the text as it is then; the last returns the packed pieces. Null texts pass all filters and are empty
documents at the end; an empty table gives an empty result; further columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashmart.llm.frames import materialize
from crashmart.llm.line_dedup import drop_lines
from crashmart.llm.near_duplicates import one_of_each
from crashmart.llm.packing import pack, pieces
from crashmart.llm.private_data import fit, mask
from crashmart.llm.queries import vocabulary
from crashmart.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT = 0.7
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go. Of a doc_id that stands for several texts all go if one does; without a doc_id a document stays."""
    docs = docs.select(*COLUMNS)
    found = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = materialize(found.where(F.col("score") >= REJECT).select("doc_id").where("doc_id is not null").distinct(), "rejected")
    return docs.join(rejected, "doc_id", "left_anti").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source are cut; all documents stay."""
    return _counted(drop_lines(docs.select(*COLUMNS)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five words, similarity 0.8 or more."""
    return one_of_each(docs.select(*COLUMNS))


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; all documents stay."""
    return _counted(mask(docs.select(*COLUMNS), fit(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row for each piece of a document."""
    return pack(pieces(docs, vocabulary("word_bpe_49k.json"), 4096), 4096)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage),
    ("private_data", private_data_stage), ("packing", packing_stage)]
ORACLE_SQL = None      # the stages learn from labels and pack by plan; tests hold them against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
