"""Person and affiliation names."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corvella.functions import vocabulary as V
from corvella.functions.text import let

# Names that are always shown in one form, by folded key.
NAME_FORMS = (
    ("ellis jason 1981", "Jason Ellis"),
    ("ellis jason", "Jason Ellis"),
    ("jason ellis", "Jason Ellis"),
    ("taylor alison 1959", "Alison Taylor"),
    ("taylor alison", "Alison Taylor"),
    ("tom sork", "Tom Sork"),
    ("thomas sork", "Tom Sork"),
    ("deirdre kelly", "Deirdre Kelly"),
)


def person_name(raw: Column) -> Column:
    """A person's name in its usual order, without titles, notes and years; null for headings and what has no letter."""

    def years_out(name: Column) -> Column:
        parts = F.filter(F.transform(F.split(name, ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^\d{4}(\s*-\s*\d{0,4})?$"))

        def swapped(p: Column) -> Column:
            given = F.get(p, F.lit(1))
            looks_given = (F.size(F.split(given, r"\s+")) <= 3) & ~given.rlike(r"\d") & given.rlike(r"^[A-ZÀ-ɏ]")
            return F.when((F.size(p) >= 2) & looks_given, F.concat_ws(" ", given, F.get(p, F.lit(0)))).otherwise(F.array_join(p, ", "))

        return let(parts, swapped)

    plain = F.trim(raw)
    name = F.trim(F.regexp_replace(plain, r"\s*\([^)]*\)\s*$", " "))
    name = F.trim(F.regexp_replace(name, r"(?i)^(dr|prof|professor|mr|mrs|ms|miss)\.?\s+", ""))
    name = years_out(name)
    name = F.regexp_replace(name, "^[\"'`]+|[\"'`]+$", "")
    name = F.trim(F.regexp_replace(F.regexp_replace(name, "_+", " "), r"\s+", " "))
    return F.when((plain == "") | F.lower(plain).isin(*V.NAME_BLOCKLIST) | ~name.rlike(r"\p{L}"), F.lit(None)).otherwise(name)


def ascii_key(name: Column) -> Column:
    """The key of a name that is ASCII already; folded_key handles others."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " "), r"\s+", " "))


#: Names recur from document to document; so many are remembered by each worker.
REMEMBERED = 1 << 17


@lru_cache(REMEMBERED)
def fold(name: str | None) -> str | None:
    if name is None:
        return None
    bare = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", name)).lower()
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", bare).split())


@F.pandas_udf(StringType())
def folded_key(names: pd.Series) -> pd.Series:
    return names.map(fold, na_action="ignore")


@lru_cache(REMEMBERED)
def without_initials(key: str) -> str:
    parts = key.split(" ")
    return " ".join(p for i, p in enumerate(parts) if i in (0, len(parts) - 1) or len(p) > 1)


def compatible(a: str, b: str) -> bool:
    """Whether two keys may be one person: equal, or equal without middle initials where only one has any."""
    if a == b:
        return True
    inner = lambda k: any(len(p) == 1 for p in k.split(" ")[1:-1])
    return without_initials(a) == without_initials(b) and not (inner(a) and inner(b))


FORMS = dict(NAME_FORMS)


def merge_names(names: list[str]) -> list[str]:
    """Normalised names, one for each person, in order of appearance; the form with more parts stays."""
    kept: list[str] = []
    for name in names:
        key = fold(name)
        if not key:
            continue
        name = FORMS.get(key) or FORMS.get(without_initials(key)) or name
        key = fold(name) or ""
        at = next((i for i, k in enumerate(kept) if compatible(key, fold(k) or "")), None)
        if at is None:
            kept.append(name)
        elif key.count(" ") > (fold(kept[at]) or "").count(" "):
            kept[at] = name
    return kept


@F.pandas_udf(ArrayType(StringType()))
def merged_names(lists: pd.Series) -> pd.Series:
    return lists.map(lambda names: merge_names([n for n in names if n]) if names is not None else [])


def valid_person(name: Column) -> Column:
    """Two words or more, three characters or more, no institution, not initials only."""
    words = F.split(F.trim(name), r"\s+")
    institution = F.lower(name).rlike(r"^(university|department|faculty|school|college|institute|centre|center)\b")
    return (F.length(F.trim(name)) >= 3) & (F.size(words) >= 2) & ~institution & ~F.forall(words, lambda w: w.rlike(r"^[A-Za-z]\.?$"))


# Rewrites that filters on affiliations share.
AFFILIATION_REWRITES = (
    (r"(?i)\bThe University of British Columbia\b", "UBC"),
    (r"(?i)\bUniversity of British Columbia\b", "UBC"),
    (r"(?i)\bSimon Fraser University\b", "SFU"),
    (r"(?i)\bUniversity of Victoria\b", "UVic"),
    (r"(?i)\bThompson Rivers University\b", "TRU"),
    (r"(?i)\bRoyal Roads University\b", "RRU"),
)


def affiliation(raw: Column) -> Column:
    out = F.trim(raw)
    for pattern, to in AFFILIATION_REWRITES:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, r"\s+", " "))
