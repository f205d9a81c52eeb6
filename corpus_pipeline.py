"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
reads it back as the next stage's ``docs``. All stages but the last return the columns of ``docs``, row by row as in
the table documents; other columns pass through.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadtide.llm.common import cut_lineage, table
from loadtide.llm.line_dedup import drop_boilerplate
from loadtide.llm.near_dup import drop_near_duplicates
from loadtide.llm.packing import pack, public_encoder
from loadtide.llm.sanitize import sanitize
from loadtide.llm.toxicity import drop_toxic, fit


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the changed text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more are rejected."""
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over 5 % of a source's pages are cut out; every document stays."""
    return _measured(drop_boilerplate(docs, host="source"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return drop_near_duplicates(docs, percent=80, words=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked, terms that give them away are generalised or removed; every document stays."""
    return _measured(sanitize(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return pack(docs, public_encoder())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: A trained classifier and a tokenizer are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
