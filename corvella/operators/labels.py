"""Topic labels: cleaning, scores, evidence and choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.functions.text import let, literals

# Labels that say nothing, and words that do not count as content.
GENERIC = (
    "academic category title; category title; education research; educational research; educational research themes; "
    "global & intercultural educational studies; global intercultural educational studies; global and intercultural educational studies; "
    "research topic; research topics; short category title; topic label; topic title"
).split("; ")
STOP = (
    "a an and are as at be by for from in into is it my of on or our the their this to was we with "
    "study research thesis dissertation education university ubc british columbia data analysis"
).split()

WORD = r"[A-Za-z][A-Za-z'’-]*"


def label_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"\s+", " ")


def clean_label(label: Column) -> Column:
    """The first line that is not blank, without a prefix and outer punctuation; null if short or generic."""
    lines = F.filter(F.transform(F.split(label, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    bare = F.regexp_replace(F.regexp_replace(first, r"(?i)^(topic\s*-?\d+\s*[:\-]\s*|label\s*[:\-]\s*)", ""), "^[ \t\r\n\"'`.,;:]+|[ \t\r\n\"'`.,;:]+$", "")
    return let(F.regexp_replace(bare, r"\s+", " "), lambda c: F.when((F.length(c) >= 3) & ~label_key(c).isin(*GENERIC), c))


def words(label: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(label, F.lit("")), F.lit(WORD), F.lit(0))


def keyword_bag(label: Column) -> Column:
    """Whether a label only lists words: slashes, a comma list without a final and/or or of over three parts, four words with nothing between."""
    parts = F.filter(F.split(label, ","), lambda p: F.trim(p) != "")
    listed = F.contains(label, F.lit(",")) & ((F.size(parts) > 3) | ~F.rlike(label, F.lit(r"(?i),\s*(and|or)\s+")))
    bare = (F.size(words(label)) >= 4) & ~F.rlike(label, F.lit(r"(?i)\b(and|of|in|for|with|through|across|among|on)\b"))
    return F.coalesce(label, F.lit("")).isin("") | F.contains(label, F.lit(" / ")) | listed | bare


def warnings(clean: Column, used: Column, fallback: Column) -> Column:
    """What speaks against a cleaned label, in order; used tells whether another topic has it."""
    n = F.size(words(clean))
    each = (
        (used, "duplicate"),
        (label_key(clean) == label_key(fallback), "matches_keyword_fallback"),
        (n < 3, "too_short"),
        ((n > 8) | (F.length(clean) > 80), "too_long"),
        (keyword_bag(clean), "keyword_like"),
    )
    return F.when(clean.isNull(), F.array(F.lit("empty_or_generic"))).otherwise(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(w)) for c, w in each])))


#: Points that each warning takes off.
COST = {"empty_or_generic": 100, "duplicate": 60, "matches_keyword_fallback": 35, "too_short": 20, "too_long": 15, "keyword_like": 30}


def score(given: Column) -> Column:
    costs = F.create_map(*[F.lit(x) for kv in COST.items() for x in kv])
    return F.greatest(F.lit(0), F.aggregate(given, F.lit(100), lambda a, w: a - F.coalesce(costs[w], F.lit(0))))


def scored(candidates: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """candidates(topic_id, label, created) with the cleaned label, warnings and score; a label that an earlier topic has is a duplicate.

    Topics go in the order of their ids; the first that uses a label has it.
    """
    rows = candidates.join(fallbacks.withColumnRenamed("label", "fallback"), "topic_id", "left").withColumn("clean", clean_label(F.col("label"))).withColumn("k", label_key(F.col("clean")))
    first = rows.filter(F.col("clean").isNotNull()).groupBy("k").agg(F.min("topic_id").alias("first_topic"))
    marked = rows.join(first, "k", "left").withColumn("warnings", warnings(F.col("clean"), F.col("first_topic") < F.col("topic_id"), F.col("fallback")))
    return marked.select("topic_id", F.col("clean").alias("label"), "created", "warnings", score(F.col("warnings")).alias("score"))


def content_terms(label: Column) -> Column:
    low = F.transform(words(label), lambda w: F.replace(F.lower(w), F.lit("’"), F.lit("'")))
    return F.filter(low, lambda w: (F.length(w) >= 3) & ~F.array_contains(literals(STOP), w))


def evidence_warnings(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """labels(topic_id, label, doc_count) with what its evidence(topic_id, title, abstract) says against each label.

    Documents meet their topic's label in one join and are counted; none is gathered.
    """
    terms = labels.withColumn("terms", content_terms(F.col("label")))
    n = F.size("terms")
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    hits = lambda t: F.size(F.filter("terms", lambda w: F.contains(t, w)))
    met = terms.join(documents, "topic_id", "left")
    supports = hits(F.concat_ws(" ", text(F.col("title")), text(F.col("abstract")))) >= F.greatest(F.lit(2), F.least(n, F.lit(3)))
    titled = hits(text(F.col("title"))) >= F.greatest(F.lit(2), F.ceil(n * 0.6))
    some = F.col("title").isNotNull() | F.col("abstract").isNotNull()
    counted = met.groupBy("topic_id", "label", "doc_count", "terms").agg(F.count_if(some).alias("docs"), F.count_if(some & supports).alias("support"), F.count_if(some & titled).alias("titled"))
    enough = (F.col("docs") >= 3) & (n >= 3)
    each = (
        ((F.col("doc_count") > 0) & (F.col("doc_count") <= 10), "small_topic_review"),
        (enough & (F.col("support") < F.greatest(F.lit(2), F.ceil(F.col("docs") * 0.3))), "low_label_coverage"),
        (enough & (F.col("titled") == 1) & (F.col("support") <= 2), "overfits_single_document"),
    )
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(w)) for c, w in each]))
    return counted.select("topic_id", "label", "docs", "support", found.alias("warnings"))


#: Points that a label loses if its topic's documents speak against it, whatever they say.
COVERAGE_COST = 25


def reviewed(candidates: DataFrame, documents: DataFrame, sizes: DataFrame) -> DataFrame:
    """candidates(topic_id, label, origin, warnings, score) that are labels, with what their documents(topic_id, title, abstract) say counted in; sizes(topic_id, doc_count).

    Warnings are joined without repeats, and any from the documents cost 25 points once. Of
    candidates of a topic that read alike the one of the smallest origin stays.
    """
    rows = candidates.filter("label IS NOT NULL")
    said = evidence_warnings(rows.select("topic_id", "label").distinct().join(sizes, "topic_id", "left"), documents)
    said = said.select("topic_id", "label", F.col("warnings").alias("said"))
    both = rows.join(said, ["topic_id", "label"], "left").withColumn("said", F.coalesce("said", F.array().cast("array<string>")))
    score = F.when(F.size("said") > 0, F.greatest(F.lit(0), F.col("score") - COVERAGE_COST)).otherwise(F.col("score"))
    one = both.select("topic_id", label_key(F.col("label")).alias("k"), F.struct("origin", "label", F.array_distinct(F.concat("warnings", "said")).alias("warnings"), score.alias("score")).alias("x"))
    return one.groupBy("topic_id", "k").agg(F.min_by("x", F.struct("x.origin", "x.label")).alias("x")).select("topic_id", "x.label", "x.origin", "x.warnings", "x.score")


def choose(topics: DataFrame, overrides: DataFrame, candidates: DataFrame, previous: DataFrame) -> DataFrame:
    """topic_id, label, origin: an override, else the best candidate that passes, else the previous label, else the default of topics(topic_id, label)."""
    passing = candidates.filter((F.col("score") >= 80) & (F.size("warnings") == 0)).groupBy("topic_id").agg(F.max_by("label", F.struct("score", "created")).alias("candidate"))
    o, p = overrides.select("topic_id", F.col("label").alias("override")), previous.select("topic_id", clean_label(F.col("label")).alias("previous"))
    rows = topics.join(o, "topic_id", "left").join(passing, "topic_id", "left").join(p, "topic_id", "left")
    outlier = F.col("topic_id") == -1
    label = F.when(outlier, "Uncategorized").otherwise(F.coalesce("override", "candidate", "previous", "label"))
    origin = F.when(outlier, "outlier").when(F.col("override").isNotNull(), "override").when(F.col("candidate").isNotNull(), "candidate").when(F.col("previous").isNotNull(), "previous").otherwise("default")
    return rows.select("topic_id", label.alias("label"), origin.alias("origin"))


def numbered(labels: DataFrame) -> DataFrame:
    """labels(topic_id, label) with repeats told apart by a number in brackets, from the second on."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(label_key(F.col("label"))).orderBy("topic_id"))
    return labels.withColumn("n", n).select("topic_id", F.when(F.col("n") == 1, F.col("label")).otherwise(F.concat("label", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).alias("label"))
