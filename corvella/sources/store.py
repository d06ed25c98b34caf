"""Stored tables and artifacts on plain file formats, which have no MERGE: each change writes a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """A keyed table as numbered Parquet folders under one path; readers see the last complete version.

    Spark writes _SUCCESS last, so a version that a failed job left behind is not seen.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS"))
        return sorted(int(s.getPath().getParent().getName()[2:]) for s in found or ())

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/v={versions[-1]}") if versions else None

    def write(self, rows: DataFrame) -> DataFrame:
        at = (self._versions() or [-1])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v={at}")
        return self.spark.read.parquet(f"{self.path}/v={at}")


def write_dictionary(concepts: DataFrame, path: str) -> None:
    """A concept dictionary(canonical, variants, doc_freq, idf) as JSON lines, replacing the one before."""
    concepts.write.mode("overwrite").json(path)


def read_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The concepts, and (variant, canonical) of their variants."""
    concepts = spark.read.schema("canonical string, variants array<string>, doc_freq long, idf double").json(path)
    return concepts, concepts.select(F.explode("variants").alias("variant"), "canonical")


def to_embed(texts: DataFrame, stored: DataFrame, least: int = 50) -> DataFrame:
    """Texts long enough for a topic model that have no stored vector yet."""
    return texts.filter(F.length(F.trim("text")) >= least).join(stored.select("doc_id"), "doc_id", "left_anti")


def latest_progress(events: DataFrame) -> DataFrame:
    """job, phase, status, at: the last event of each phase of each job."""
    return events.groupBy("job", "phase").agg(F.max_by("status", F.struct("at", "id")).alias("status"), F.max("at").alias("at"))


def any_holding(found: DataFrame) -> DataFrame:
    """query, n, found: whether any of a discovery service's results(query, in_holdings) is held."""
    return found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.bool_or("in_holdings").alias("found"))
