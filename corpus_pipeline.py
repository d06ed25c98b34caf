"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.llm import line_dedup, packing, pii, quality_classifier
from corvella.llm.near_copies import keep_first
from corvella.llm.store import Cuts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (score below 0.3).

    Null, empty and blank texts have the score of a text without features. Repeated rows are
    scored each, alike where their texts are. Without labels all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, labels))


def _with_length(docs: DataFrame, names: list[str]) -> DataFrame:
    """The stage's rows with n_chars, where there is one, as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names) if "n_chars" in names else docs.select(*names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves each line that three documents or more share in the largest of them only. A null text becomes an empty one; all rows stay."""
    return _with_length(line_dedup.dedup_lines(docs), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, Jaccard index 0.8 or more), the one of the smallest id.

    SimHash finds the candidates, whole sets decide. Texts without words are copies of one
    another; rows with a null id stay; of rows that repeat an id all or none stay.
    """
    return keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets. Null texts and texts without any stay as they are; all rows stay."""
    return _with_length(pii.mask(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: one row a piece. Texts without words have one empty piece without a bin."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near_copies), ("personal data", personal_data), ("packing", pack)]

#: SQL has no hashing of shingles and no trained scores; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents, each stage's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cuts = Cuts(spark, "pipeline")
    last = None
    for name, stage in STAGES:
        docs = cuts.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            cuts.drop(last)
        last = docs
    return docs
