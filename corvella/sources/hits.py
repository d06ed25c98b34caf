"""Records from a paged search API: hit extraction, normalisation, and a data source that reads pages in parallel."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corvella.functions.names import merged_names, person_name
from corvella.functions.text import estimated_pages, first_present, flat_text, methodologies, page_count, year_in
from corvella.operators.phrases import document_concepts
from corvella.operators.records import UNSPECIFIED, addresses

# Where a payload may hold its hits, and a record its fields, by the first name that has a value.
HIT_PATHS = ("$.data.hits.hits", "$.hits.hits", "$.data.hits", "$.hits", "$.data.results", "$.results", "$.data.items", "$.items", "$.data", "$.docs")
FIELDS = {
    "raw_id": ("_id", "id", "identifier", "Identifier"),
    "title": ("title", "Title", "name", "Name"),
    "creators": ("creator", "Creator", "author", "Author"),
    "supervisors": ("supervisor", "Supervisor"),
    "affiliation": ("affiliation", "Affiliation"),
    "date": ("date_available", "DateAvailable", "dateAvailable", "dateIssued", "DateIssued", "graduationDate", "GraduationDate", "ubc_date_sort", "date", "Date", "year", "Year", "issued", "Issued"),
    "description": ("description", "Description", "abstract", "Abstract"),
    "full_text": ("full_text", "FullText", "transcript", "text", "ocr", "body"),
    "subjects": ("subject", "Subject", "subjects", "keywords", "keyword"),
    "program": ("program_theses", "program", "Program"),
    "degree": ("degree_theses", "degree", "Degree"),
    "genre": ("genre", "Genre"),
    "extent": ("extent", "Extent"),
    "uri": ("uri", "URI", "isShownAt", "identifier", "Identifier"),
    "rights": ("rights", "Rights"),
    "doi": ("doi", "DOI"),
    "original_record": ("digitalResourceOriginalRecord", "DigitalResourceOriginalRecord", "digital_resource_original_record", "originalRecord", "OriginalRecord"),
    "campus": ("campus", "Campus"),
    "scholarly_level": ("scholarly_level", "scholarlyLevel", "ScholarlyLevel"),
}
ADDRESS_FIELDS = ("URI", "uri", "isShownAt", "IsShownAt", "hasView", "HasView", "identifier", "Identifier", "digitalResourceOriginalRecord", "doi", "DOI")
ID_FORMS = (r"^(\d+\.\d+)$", r"(?i)/items/(\d+\.\d+)(?:[/?#]|$)", r"(?i)/pdf/\d+/(\d+\.\d+)(?:[/?#]|$)")


def hits(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row a hit of each JSON payload: its source record as JSON, from the first path that holds an array."""
    found = F.coalesce(*[F.from_json(F.when(F.startswith(F.get_json_object(column, p), F.lit("[")), F.get_json_object(column, p)), "array<string>") for p in HIT_PATHS])
    one = payloads.select(F.explode(found).alias("hit"))
    inner = F.coalesce(F.get_json_object("hit", "$._source"), F.get_json_object("hit", "$.doc"), F.col("hit"))
    return one.select(inner.alias("record"), F.get_json_object("hit", "$._index").alias("index"), F.coalesce(F.get_json_object("hit", "$._id"), F.get_json_object("hit", "$._source.id")).alias("hit_id"))


def field(values: Column, names: tuple[str, ...]) -> Column:
    """A record's field, as a variant, from the map of its values: under the first of its names that is neither absent, null nor ''; an empty list counts as a value."""

    # Over an array of names, as code for each name apart grows too long to be compiled.
    found = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.try_element_at(values, n))
    some = F.filter(found, lambda x: x.isNotNull() & ~F.is_variant_null(x) & (F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("?")) != ""))
    return F.get(some, F.lit(0))


def listed(value: Column) -> Column:
    """A variant as trimmed strings that are not empty: a list's values, those of lists in it too, else one value. False, 0 and null give none; objects their JSON."""
    text = lambda x: F.try_variant_get(x, "$", "string")
    inner = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<string>"), F.array(text(x)))
    every = F.coalesce(F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), inner)), F.array(text(value)))
    return F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x.isNotNull() & ~x.isin("", "false", "0"))


def stable_id(*texts: Column) -> Column:
    """The first id that a text is, or that an address in it names under items or pdf; null where none does."""
    found = [F.nullif(F.regexp_extract(F.trim(x), form, 1), F.lit("")) for x in texts for form in ID_FORMS]
    return F.coalesce(*found)


def records(found: DataFrame, items: str | None = None, dictionary: DataFrame | None = None, n_docs: int = 0) -> DataFrame:
    """The 35 fields of hits(record, hit_id): texts are '' and lists empty where a field is missing.

    Each record is parsed once, as a variant. doc_id is the id that the record, its address or
    one of its files' addresses names, else title:author. items: where a record's page is, up
    to its id, as one more address. dictionary(canonical, variants, idf, doc_freq): concepts of
    n_docs documents for concept_terms, which are empty without it. Records that are no JSON
    objects give empty fields.
    """
    # A look into a variant goes over its names as text, one into a map compares bytes: records are opened once for all names.
    parsed = found.select("hit_id", F.try_variant_get(F.try_parse_json("record"), "$", "map<string,variant>").alias("v"))
    fields = parsed.select("hit_id", *[field(F.col("v"), names).alias(k) for k, names in FIELDS.items()], F.array(*[F.try_element_at("v", F.lit(n)) for n in ADDRESS_FIELDS]).alias("places"))
    own = F.coalesce(F.nullif(flat_text(listed(F.col("raw_id"))), F.lit("")), "hit_id", F.lit(""))
    lists = {k: listed(F.col(k)) for k in ("creators", "supervisors", "affiliation", "subjects", "program", "degree", "genre", "extent")}
    texts = {k: flat_text(listed(F.col(k))) for k in ("title", "description", "full_text", "uri", "rights", "doi", "original_record", "campus", "scholarly_level")}
    flat = fields.select(own.alias("raw_id"), F.coalesce(F.try_variant_get("date", "$", "string"), F.lit("")).alias("date"), "places", *[v.alias(k) for k, v in (lists | texts).items()])
    near = addresses(F.flatten(F.transform("places", listed)))
    if items is not None:
        near = F.when(F.col("raw_id") == "", near).otherwise(F.array_distinct(F.concat(near, F.array(F.concat(F.lit(items), F.url_encode("raw_id"))))))
    # Flat texts have single blanks only, so words are what blanks part, and no long text goes further than here.
    plain = F.col("plain")
    words = F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")
    flat = flat.withColumn("download_candidates", near).withColumn("plain", F.coalesce(first_present(F.col("full_text"), F.col("description")), F.lit("")))
    flat = flat.withColumns({"word_count": words, "char_count": F.length(plain).cast("long")}).drop("plain", "full_text")
    pages = page_count(F.col("extent"))
    first = F.coalesce(F.get("creators", F.lit(0)), F.lit(""))
    by_address = F.get(F.array_compact(F.transform("download_candidates", lambda x: stable_id(x))), F.lit(0))
    people = merged_names(F.transform("supervisors", person_name))
    none = F.array().cast("array<string>")
    out = flat.select(
        F.coalesce(stable_id(F.col("raw_id"), F.col("uri")), by_address, F.concat("title", F.lit(":"), first)).alias("doc_id"),
        "title",
        F.col("creators").alias("authors"),
        F.coalesce(F.nullif(first, F.lit("")), F.lit("Unknown")).alias("author"),
        people.alias("supervisors"),
        F.when(F.size("supervisors") > 0, "api").alias("supervisors_source"),
        "affiliation",
        "date",
        year_in(F.col("date")).alias("year"),
        F.array_join("degree", "; ").alias("degree"),
        F.array_join("program", "; ").alias("program"),
        F.array_join("genre", "; ").alias("type"),
        "rights",
        "doi",
        "campus",
        "scholarly_level",
        F.array_join("extent", "; ").alias("extent"),
        F.coalesce(F.nullif(pages, F.lit(0)).cast("long"), estimated_pages(F.col("word_count"))).alias("page_count"),
        F.when(pages > 0, "metadata_extent").otherwise("estimated_from_metadata_words").alias("page_source"),
        F.col("description").alias("abstract"),
        F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit(UNSPECIFIED))).alias("subjects"),
        "word_count",
        F.lit("metadata_text").alias("word_source"),
        "char_count",
        none.alias("themes"),
        methodologies(F.concat_ws(" ", "title", "description", F.array_join("subjects", " "))).alias("methodologies"),
        none.alias("concept_terms"),
        "uri",
        F.col("original_record").alias("original_record_url"),
        "download_candidates",
        F.lit(None).cast("string").alias("download_url"),
        F.lit("not_attempted").alias("download_status"),
        F.lit(None).cast("string").alias("download_error"),
        F.lit(None).cast("long").alias("file_bytes"),
        F.lit(None).cast("long").alias("body_word_count"),
    )
    if dictionary is None:
        return out
    said = F.array_join(F.filter("subjects", lambda x: x != UNSPECIFIED), " / ")
    used = document_concepts(out.select("doc_id", "title", F.concat_ws(" / ", "abstract", said).alias("text")), dictionary, n_docs)
    terms = used.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "concept"))), lambda x: x["concept"]).alias("terms"))
    return out.join(terms, "doc_id", "left").select(*[F.coalesce("terms", "concept_terms").alias(c) if c == "concept_terms" else F.col(c) for c in out.columns])


class Page(InputPartition):
    def __init__(self, start: int, size: int):
        super().__init__((start, size))
        self.start, self.size = start, size


class Extent:
    """How many hits an API has, from what its pages say.

    The first page tells the total, or nothing does. As pages may end before it (some APIs
    serve no more than so many), the last one is looked at; the first empty page is then found
    by doubling and halving, so planning takes some dozens of small requests and never all.
    """

    def __init__(self, options):
        module, _, function = options["fetch"].partition(":")
        self.where, self.size = (module, function), max(1, int(options.get("page_size", "100")))
        self.most = int(options["limit"]) if "limit" in options else None
        self.told = int(options["total"]) if "total" in options else None
        self.columns = [c for c in options.get("columns", "").split(",") if c]
        self.arguments = {k[4:]: v for k, v in options.items() if k.startswith("arg.")}

    def fetch(self, start: int, size: int) -> str:
        module, function = self.where
        payload = getattr(importlib.import_module(module), function)(start, size, self.columns, **self.arguments)
        return payload if isinstance(payload, str) else json.dumps(payload)

    @staticmethod
    def held(payload: str) -> int:
        """Hits of a payload, from the first path that holds a list."""
        whole = json.loads(payload)
        for path in HIT_PATHS:
            at = whole
            for name in path.split(".")[1:]:
                at = at.get(name) if isinstance(at, dict) else None
            if isinstance(at, list):
                return len(at)
        return 0

    @staticmethod
    def total(payload: str) -> int | None:
        """The total that a payload tells, as a number or as an object with a value."""
        whole = json.loads(payload)
        for path in (("data", "hits", "total"), ("hits", "total"), ("total",)):
            at = whole
            for name in path:
                at = at.get(name) if isinstance(at, dict) else None
            at = at.get("value") if isinstance(at, dict) else at
            if isinstance(at, int) and not isinstance(at, bool):
                return at
        return None

    def end(self, known: int = 0) -> int:
        """The place behind the last hit, `known` of which have been seen before; the limit if that is less."""
        first = self.fetch(0, self.size)
        if not self.held(first):
            return known
        top = self.told if self.told is not None else self.total(first)
        if self.most is not None:
            top = self.most if top is None else min(top, self.most)
        there = lambda at: self.held(self.fetch(at, 1)) > 0
        if top is not None and (top <= 0 or there(top - 1)):
            return max(known, top)
        low = max(known, self.held(first)) - 1  # a hit is there
        if low < 0 or top is not None and low >= top:
            return max(known, 0)
        step = self.size
        high = low + step
        while (top is None or high < top) and there(high):
            low, step = high, step * 2
            high = low + step
        high = high if top is None else min(high, top)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if there(middle) else (low, middle)
        return max(known, low + 1)

    def pages(self, start: int, end: int) -> list[Page]:
        return [Page(at, min(self.size, end - at)) for at in range(start, end, self.size)]


class PagedHits(DataSource):
    """Pages of a search API as JSON payloads, one input partition a page, as a table or as a stream.

    Options: fetch ("module:function" of (start, size, columns) giving a payload as text or
    dict, importable on the executors; options arg.x go to it as x), page_size, total (else
    the first page tells it, or the first empty page ends the scan), limit, columns
    (comma-joined; the API's projection). A page that a lost executor was reading is read
    again. A stream's offset is the number of hits, so a batch that is tried again has the
    same hits, and a later batch those that have been added behind them.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_hits"

    def schema(self) -> str:
        return "start long, payload string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(self.options)


def _read(extent: Extent, page: Page | None) -> Iterator[tuple[int, str]]:
    # A scan without pages is one read of none.
    if page is not None:
        yield page.start, extent.fetch(page.start, page.size)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.extent = Extent(options)

    def partitions(self) -> list[Page]:
        return self.extent.pages(0, self.extent.end())

    def read(self, page: Page) -> Iterator[tuple[int, str]]:
        return _read(self.extent, page)


class PagedStream(DataSourceStreamReader):
    def __init__(self, options):
        self.extent, self.seen = Extent(options), 0

    def initialOffset(self) -> dict:
        return {"hits": 0}

    def latestOffset(self) -> dict:
        self.seen = self.extent.end(self.seen)
        return {"hits": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.seen = max(self.seen, end["hits"])
        return self.extent.pages(start["hits"], end["hits"])

    def read(self, page: Page) -> Iterator[tuple[int, str]]:
        return _read(self.extent, page)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""
