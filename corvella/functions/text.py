"""Text functions as Column expressions; the domain canonicaliser is an Arrow UDF, as Spark has no Unicode normalisation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvella.functions import vocabulary as V


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literals(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def first_present(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def flat_text(parts: Column) -> Column:
    """Array parts joined by a blank, white space collapsed (Unicode), '' for null."""
    return F.coalesce(F.trim(F.regexp_replace(F.concat_ws(" ", parts), r"(?U)\s+", " ")), F.lit(""))


def year_in(text: Column) -> Column:
    """The first 19xx or 20xx anywhere in the text."""
    return F.nullif(F.regexp_extract(text, r"(19|20)\d{2}", 0), F.lit("")).try_cast("int")


def page_count(extents: Column) -> Column:
    """Pages named by the first extent that names any: a number before pages, p. or leaves."""
    named = F.filter(F.transform(extents, lambda x: F.regexp_extract(F.lower(x), r"(\d{1,5})\s*(pages?|p\.|leaves?)", 1)), lambda x: x != "")
    return F.get(named, F.lit(0)).try_cast("int")


def word_count(text: Column) -> Column:
    """Words between runs of white space; 0 for null or blank."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " "))).cast("long")


def estimated_pages(words: Column, per_page: int = 300) -> Column:
    return F.greatest(F.lit(1), F.floor(words / per_page + 0.5)).cast("long")


def tokens(text: Column, stop_words: Iterable[str] = V.STOP_WORDS) -> Column:
    """Lower-cased terms of four characters or more out of [a-z0-9-], without stop words and those that start with a digit."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s-]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: (F.length(t) >= 4) & ~t.isin(*stop_words) & ~t.rlike("^[0-9]"))


def windows(words: Column, n: int) -> Column:
    """All runs of n words, in order."""
    return let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>")))


def skippable(token: Column, stop_words: Iterable[str] = V.STOP_WORDS, cardinals: Iterable[str] = V.CARDINALS) -> Column:
    """Tokens that no phrase may hold: short, stop and number words, years, numbers."""
    return (F.length(token) < 4) | token.isin(*stop_words, *cardinals) | token.rlike(r"^[0-9]{4}[a-z]?$") | token.rlike(r"^[0-9]+$")


def low_signal_phrase(words: Column) -> Column:
    """Whether a phrase, as an array of words, says little: too short, repeating itself, or with blocked words."""
    head, start = F.element_at(words, -1), F.element_at(words, 1)
    few = F.size(words) < 2
    blocked = F.arrays_overlap(words, literals(V.LOW_ANYWHERE)) | head.isin(*V.LOW_HEADS) | start.isin(*V.LOW_STARTS) | (start == "columbia")
    return few | (F.size(F.array_distinct(words)) < F.size(words)) | blocked


def low_signal_term(phrase: Column) -> Column:
    """Whether a concept term says little; stricter than low_signal_phrase."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(phrase, F.lit(""))), r"\s+", " "))

    def judge(p: Column) -> Column:
        words = F.split(p, " ")
        listed = p.isin(*V.LOW_TERMS) | reduce(lambda a, b: a | b, [p.rlike(x) for x in V.LOW_TERM_PATTERNS])
        return (p == "") | listed | F.arrays_overlap(words, literals(V.NUMBER_WORDS + V.TERM_ANYWHERE)) | F.element_at(words, -1).isin(*V.TERM_HEADS) | low_signal_phrase(words)

    return let(plain, judge)


def ngrams(words: Column, n: int, stop_words: Iterable[str] = V.STOP_WORDS) -> Column:
    """Phrases of n words without skippable words and low-signal phrases, in order, with repeats."""
    kept = F.filter(windows(words, n), lambda w: ~F.exists(w, lambda t: skippable(t, stop_words)) & ~low_signal_phrase(w))
    return F.transform(kept, lambda w: F.array_join(w, " "))


#: Lower-case signs of a denial right before a label, looked back over as a bounded context.
DENIAL = r"(?<!\b(?:not|no|without|neither|never)\b[\w\s-]{0,35})"


def methodologies(text: Column, labels: Iterable[tuple[str, str]] = V.METHODOLOGIES, denials: bool = True) -> Column:
    """Labels whose pattern the text matches at least once without a denial before it, in the labels' order."""
    # The label is looked for first, as the look-behind is dear.
    form = f"(?i)(?=%s){DENIAL}" if denials else "(?i)%s"
    return F.array_compact(F.array(*[F.when(text.rlike(form % p), F.lit(label)) for label, p in labels]))


def plain_stem(token: Column) -> Column:
    """Plural ending off: -ies to -y, -s dropped, not -ss."""
    ies = (F.length(token) > 5) & token.endswith("ies")
    s = (F.length(token) > 4) & token.endswith("s") & ~token.endswith("ss")
    return F.when(ies, F.regexp_replace(token, "ies$", "y")).when(s, F.regexp_replace(token, "s$", "")).otherwise(token)


def phrase_similarity(a: Column, b: Column) -> Column:
    """Jaccard index of the stems, plus 0.2 if one phrase starts the other, or 0.7 if only related heads tell them apart."""

    def compare(s: Column, t: Column) -> Column:
        share = F.size(F.array_intersect(s, t)) / F.size(F.array_union(s, t))
        x, y = F.array_join(s, " "), F.array_join(t, " ")
        starts = x.startswith(y) | y.startswith(x)
        h, g = F.element_at(s, -1), F.element_at(t, -1)
        front = F.slice(s, F.lit(1), F.size(s) - 1) == F.slice(t, F.lit(1), F.size(t) - 1)
        related = (F.size(s) == F.size(t)) & (F.size(s) >= 2) & (h != g) & (F.least(F.length(h), F.length(g)) >= 5) & (h.startswith(g) | g.startswith(h)) & front
        return share + F.when(related, 0.7).when(starts, 0.2).otherwise(0.0)

    stems = lambda w: F.transform(w, plain_stem)
    both = let(stems(a), lambda s: let(stems(b), lambda t: compare(s, t)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def tenth(value: Column) -> Column:
    """Rounded to one decimal, halves up."""
    return F.floor(value * 10 + 0.5) / 10


def folded(text: str) -> str:
    """Without diacritics, lower-cased, only [a-z0-9] and single blanks."""
    bare = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", text))
    return " ".join(re.sub(r"[_-]+", " ", re.sub(r"[^a-z0-9\s-]", " ", bare.lower())).split())


@lru_cache(maxsize=4)
def _variants(entries: tuple) -> tuple[re.Pattern, dict[str, str]]:
    to: dict[str, str] = {}
    for canonical, others in entries:
        for v in (canonical, *others):
            if folded(v):
                to.setdefault(folded(v), folded(canonical))
    longest = sorted(to, key=lambda v: -v.count(" "))
    return re.compile(r"(?<!\S)(?:" + "|".join(map(re.escape, longest)) + r")(?!\S)"), to


def canonical_text(text: str | None, entries: tuple = V.DOMAIN_VARIANTS) -> str:
    """Folded text with variants replaced by their canonical form, left to right, longest variant first."""
    pattern, to = _variants(entries)
    return pattern.sub(lambda m: to[m[0]], folded(text or ""))


@F.pandas_udf(StringType())
def canonicalise(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, or else lines, trimmed."""
    return F.transform(F.split(text, r"\n{2,}|\r?\n"), lambda p: F.trim(p))


# What pages say that block a download.
BLOCK_SIGNS = ("captcha", "access denied", "verify you are human", "unusual traffic", "checking your browser")


def blocks_download(html: Column, signs: Iterable[str] = BLOCK_SIGNS) -> Column:
    """Whether a page is a challenge or a refusal and not the file that was asked for."""
    low = F.lower(F.coalesce(html, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in signs])
