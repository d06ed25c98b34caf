"""Shaping of records and of what is shown: keys, repairs, merges, filters, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.operators.merge import upsert

# Headings that were stored as names, fields that a source list must have, and fields that may hold addresses.
ARTEFACTS = (
    "additional supervisory committee members:",
    "additional supervisory committee members",
    "examining committee members",
    "examining committee",
    "supervisory committee members",
    "supervisory committee",
    "committee members",
)
SOURCE_FIELDS = ("id", "identifier", "uri", "digitalResourceOriginalRecord")
UNSPECIFIED = "(Unspecified)"


def without_artefacts(committee: DataFrame) -> DataFrame:
    """committee without headings that were read as names; rows without a name stay."""
    return committee.filter(~F.coalesce(F.lower("name").isin(*ARTEFACTS), F.lit(False)))


def merged_citations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Citations by hash: a new value wins where there is one. Both have a row a hash and equal columns."""
    return upsert(old, new, "hash", tuple(c for c in old.columns if c != "hash"))


def touched_links(links: DataFrame) -> DataFrame:
    """doc_id, citation_id, updated_at: each link once, as of its last touch."""
    return links.groupBy("doc_id", "citation_id").agg(F.max("updated_at").alias("updated_at"))


def merged_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rules by id: the new one wins, but its creation stays the first."""
    both = upsert(old, new, "id")
    first = old.select("id", "created_at").unionByName(new.select("id", "created_at")).groupBy("id").agg(F.min("created_at").alias("first"))
    return both.join(first, "id").select(*[F.col("first").alias(c) if c == "created_at" else F.col(c) for c in both.columns])


def addresses(fields: Column) -> Column:
    """The distinct http addresses in an array of strings, in order: a string that starts as one whole, else those within it."""

    def of(text: Column) -> Column:
        plain = F.trim(text)
        return F.when(F.rlike(plain, F.lit("(?i)^https?://")), F.array(plain)).otherwise(F.regexp_extract_all(plain, F.lit("(?i)https?://[^\\s\"'<>]+"), F.lit(0)))

    return F.array_distinct(F.flatten(F.transform(F.filter(fields, lambda x: x.isNotNull()), of)))


def source_fields(source: Column) -> Column:
    """A comma list of fields with those appended that it lacks, in any letters."""
    own = F.filter(F.transform(F.split(F.coalesce(source, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(own, lambda x: F.lower(x))
    missing = [F.when(~F.array_contains(low, f.lower()), F.lit(f)) for f in SOURCE_FIELDS]
    return F.array_join(F.concat(own, F.array_compact(F.array(*missing))), ",")


def repaired(records: DataFrame, lists: tuple[str, ...], subjects: str = "subjects", chars: str = "char_count", text: str = "abstract") -> DataFrame:
    """Records with empty lists for null ones, a subject where there is none, and the text's length where it is not stored."""
    none = F.array().cast("array<string>")
    fixed = {c: F.coalesce(c, none) for c in lists}
    known = F.coalesce(subjects, none)
    fixed[subjects] = F.when(F.size(known) == 0, F.array(F.lit(UNSPECIFIED))).otherwise(known)
    fixed[chars] = F.coalesce(F.col(chars), F.length(F.coalesce(text, F.lit(""))).cast("long"))
    return records.withColumns(fixed)


def healed(stored: DataFrame, fresh: DataFrame, key: str, metrics: tuple[str, ...]) -> DataFrame:
    """fresh with the stored metrics where they are known and not zero."""
    old = stored.select(key, *[F.col(c).alias(f"__{c}") for c in metrics])
    both = fresh.join(old, key, "left")
    return both.select(*[F.coalesce(F.nullif(f"__{c}", F.lit(0)), F.col(c)).alias(c) if c in metrics else F.col(c) for c in fresh.columns])


def concept_id(term: Column) -> Column:
    return F.concat(F.lit("c:"), F.regexp_replace(term, r"\s+", "_"))


def sync_key(base: Column, index: Column, query: Column, term: Column, source: Column) -> Column:
    """The settings of a sync as JSON with fields in one order; missing ones are ''."""
    some = lambda c: F.coalesce(c, F.lit(""))
    return F.to_json(F.struct(base.alias("baseUrl"), some(index).alias("requestedIndex"), some(query).alias("query"), some(term).alias("term"), source_fields(source).alias("source")))


def with_committee(docs: DataFrame, committee: DataFrame, supervising: tuple[str, ...] = ("Supervisor", "Co-Supervisor")) -> DataFrame:
    """docs with members (in their order), supervisors (distinct, in that order) and supervisors_source (api, pdf_fallback or null)."""
    one = F.struct("pos", "name", "role", "affiliation", "source")
    lists = committee.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("members"))
    leads = lists.withColumn("leads", F.filter("members", lambda m: m["role"].isin(*supervising)))
    named = leads.select("doc_id", "members", F.array_distinct(F.transform("leads", lambda m: m["name"])).alias("supervisors"), F.when(F.size("leads") > 0, F.when(F.exists("leads", lambda m: m["source"] == "api"), "api").otherwise("pdf_fallback")).alias("supervisors_source"))
    return docs.join(named, "doc_id", "left")


def resolved_index(requests: DataFrame, collections: DataFrame) -> DataFrame:
    """requests(requested) with index: numbers stay, names become their collection's number in any letters, others stay as asked."""
    names = collections.select(F.lower("name").alias("__name"), F.col("index").cast("string").alias("__index"))
    both = requests.join(names, F.lower("requested") == F.col("__name"), "left")
    number = F.rlike("requested", F.lit(r"^\d+$"))
    return both.select(*requests.columns, F.when(number, F.col("requested")).otherwise(F.coalesce("__index", "requested")).alias("index"))


def pdf_pages(content: Column, info: Column | None = None) -> Column:
    """Pages of a PDF's bytes: those that its description names, else how many page objects it holds; null for none."""
    named = F.regexp_extract(F.coalesce(info, F.lit("")), r"(?m)^Pages:\s*(\d+)", 1).try_cast("long") if info is not None else F.lit(None).cast("long")
    return F.coalesce(F.nullif(named, F.lit(0)), F.nullif(F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"/Type\s*/Page\b")).cast("long"), F.lit(0)))


def file_status(cached_pdf: Column, cached_text: Column, url: Column, downloaded: Column, recompute: bool = False) -> Column:
    """What an analysis of a document's file comes to, the first that holds: its stored PDF, its stored text, a download, nothing to ask for."""
    stored = F.when(cached_pdf, "recomputed_from_cache" if recompute else "cached").when(cached_text, "cached_full_text")
    return stored.when(F.lit(recompute), "not_found").when(downloaded, "downloaded").when(url.isNotNull() & (url != ""), "error").otherwise("not_found")


def table_filter(rows: DataFrame, columns: list[Column], wanted: str) -> DataFrame:
    """Rows of which some of the columns, joined, hold the wanted text in any letters; '' takes all."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted.lower())))


def people_filter(people: DataFrame, role: str | None = None, wanted: str = "") -> DataFrame:
    """people(name, roles, affiliations, ...) of a role, with a text in one of these."""
    rows = people if role is None else people.filter(F.array_contains(F.split("roles", "; "), role))
    return table_filter(rows, [F.col("name"), F.col("roles"), F.col("affiliations")], wanted)


#: Orders of people, each with the name as the last word.
PEOPLE_ORDERS = {"name": (), "documents": (F.desc, "doc_count"), "roles": (F.asc, "roles"), "years": (F.asc_nulls_last, "first_year")}


def people_sorted(people: DataFrame, by: str) -> DataFrame:
    order = PEOPLE_ORDERS[by]
    return people.orderBy(*([order[0](order[1])] if order else []), F.lower("name"), "name")


def formatted_number(value: Column) -> Column:
    """With commas and no decimals; a dash for null."""
    return F.coalesce(F.format_number(value, 0), F.lit("-"))


def formatted_bytes(size: Column) -> Column:
    """Bytes, or KB and MB with one decimal; a dash for null and zero."""
    tenth = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    kb, mb = size / 1024.0, size / 1048576.0
    return F.when(F.coalesce(size, F.lit(0)) == 0, "-").when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, F.concat(tenth(kb), F.lit(" KB"))).otherwise(F.concat(tenth(mb), F.lit(" MB")))


def plottable(rows: DataFrame) -> DataFrame:
    """Rows with a place and a topic."""
    return rows.dropna(subset=["x", "y", "topic_id"])

