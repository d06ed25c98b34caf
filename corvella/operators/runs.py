"""Run logs, settings, import rules and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fields of an import rule and the ranges of request parameters.
RULE_FIELDS = (("degree", "degree.raw"), ("program", "program.raw"), ("affiliation", "affiliation.raw"))
RANGES = {"max_records": (1, 9999), "page_size": (1, 100), "scan_limit": (1, 50_000), "subject_limit": (1, 100)}
LENGTHS = {"index": 200, "query": 500, "term": 500, "source": 2000}


def rule_term(rules: DataFrame) -> DataFrame:
    """rules with term: its fields that are not blank, as field,value joined by semicolons."""
    part = lambda c, to: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{to},"), F.trim(c)))
    return rules.withColumn("term", F.concat_ws(";", *[part(F.col(f), to) for f, to in RULE_FIELDS]))


def run_key(source: Column) -> Column:
    """The key of a run's source struct: the SHA-1 of its JSON in field order."""
    return F.sha1(F.to_json(source))


def newest(runs: DataFrame, order: str, limit: int) -> DataFrame:
    return runs.orderBy(F.desc(order), F.desc("id")).limit(limit)


def settings(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """key, value: the stored settings with the changes; the last change of a key wins."""
    last = changes.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(F.desc("at")))).filter("n = 1").select("key", "value")
    return rows.select("key", "value").join(last.select("key"), "key", "left_anti").unionByName(last)


def conflicts(fixed: DataFrame, learned: DataFrame) -> DataFrame:
    """variant, fixed, learned: variants that two dictionaries lead to different canonical forms."""
    a, b = fixed.withColumnRenamed("canonical", "fixed"), learned.withColumnRenamed("canonical", "learned")
    return a.join(b, "variant").filter(F.col("fixed") != F.col("learned")).select("variant", "fixed", "learned")


def checked(**given: int | str | None) -> list[str]:
    """What is wrong with request parameters; nothing if they can be used."""
    wrong = []
    for name, value in given.items():
        if value in (None, ""):
            continue
        if name in RANGES:
            low, high = RANGES[name]
            try:
                good = low <= float(value) <= high
            except ValueError:
                good = False
            if not good:
                wrong.append(f"{name} must be between {low} and {high}.")
        elif name in LENGTHS and len(str(value)) > LENGTHS[name]:
            wrong.append(f"{name} must be at most {LENGTHS[name]} characters.")
    return wrong
