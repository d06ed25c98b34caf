"""Citation normalisation, search terms and exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rewrites that equal citations must share, as (pattern, replacement).
REWRITES = (
    (r"\.", ""),
    (r"\bthe\b\s*", ""),
    (r"\bmass(achusetts)?\b", "ma"),
    (r"\bconn(ecticut)?\b", "ct"),
    (r"\bcalif(ornia)?\b", "ca"),
    (r"\bnew york\b", "ny"),
    (r"\bn y\b", "ny"),
    (r"\bnew jersey\b", "nj"),
    (r"\bn j\b", "nj"),
    (r"\bont(ario)?\b", "on"),
    (r"\bbc\b|\bbritish columbia\b", "bc"),
    (r"\b([a-z]) ([a-z])\b", "$1$2"),
    (r"\b([a-z]) ([a-z])\b", "$1$2"),
    (r";\s*", ", "),
    (r",\s*\(", " ("),
    (r"\s+\(", "("),
    (r"\s*([,:]) \s*", "$1 "),
    (r"\s+", " "),
    (r"[,;:\s]+$", ""),
)


def normal_citation(text: Column) -> Column:
    out = F.lower(text)
    for pattern, to in REWRITES:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def citation_hash(text: Column) -> Column:
    return F.sha1(normal_citation(text))


def csl_text(csl: Column) -> Column:
    """One line from a CSL struct(author array<struct<family, given>>, year, title, container, volume, issue, page, publisher)."""
    authors = F.array_join(F.transform(csl["author"], lambda a: F.concat_ws(", ", F.nullif(a["family"], F.lit("")), F.nullif(a["given"], F.lit("")))), "; ")
    present = lambda c: F.nullif(c, F.lit(""))
    volume = F.concat(present(csl["volume"]), F.coalesce(F.concat(F.lit("("), present(csl["issue"]), F.lit(")")), F.lit("")))
    return F.concat_ws(". ", present(authors), F.concat(F.lit("("), present(csl["year"]), F.lit(")")), present(csl["title"]), present(csl["container"]), volume, present(csl["page"]), present(csl["publisher"]))


def short_label(text: Column) -> Column:
    """First surname and year of a citation, or its first 24 characters."""
    name, year = F.regexp_extract(text, r"^([^,.(]+)", 1), F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)
    return F.when((name != "") & (year != ""), F.concat_ws(", ", F.trim(name), year)).otherwise(F.substring(text, 1, 24))


def ris(kind: Column, title: Column, author: Column, year: Column, abstract: Column) -> Column:
    """One RIS record; absent fields have no line."""
    line = lambda tag, c: F.concat(F.lit(f"{tag}  - "), F.nullif(c.cast("string"), F.lit("")))
    return F.concat_ws("\n", line("TY", kind), line("TI", title), line("AU", author), line("PY", year), line("AB", F.substring(abstract, 1, 500)), F.lit("ER  - "))


def bibtex(title: Column, author: Column, year: Column) -> Column:
    key = F.concat(F.substring(F.regexp_replace(F.coalesce(author, F.lit("")), "[^A-Za-z0-9]", ""), 1, 20), F.coalesce(year.cast("string"), F.lit("")))
    field = lambda tag, c: F.concat(F.lit(f"  {tag} = {{"), F.nullif(c.cast("string"), F.lit("")), F.lit("}"))
    return F.concat(F.lit("@phdthesis{"), key, F.lit(",\n"), F.concat_ws(",\n", field("title", title), field("author", author), field("year", year)), F.lit("\n}"))


def pqf_value(value: Column) -> Column:
    """A value for a prefix query: control characters, quotes and backslashes out, 240 characters at most."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(value, r'[\x00-\x1F\x7F"\\]', " "), r"\s+", " ")), 1, 240)
