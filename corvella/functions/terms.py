"""Terms and phrases of whole texts, found and counted in the row that holds the text.

The same as tokens() and ngrams() of functions/text.py, as Arrow UDFs: an array function with
a lambda is interpreted word by word, which at a gigabyte of text is most of a query's time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvella.functions import vocabulary as V
from corvella.functions.held import may_hold

COUNTS = "array<struct<term:string,tf:bigint>>"


def _blanks_but(kept: str) -> bytes:
    return bytes(b if chr(b) in kept else 32 for b in range(256))


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
TERMS, WORDS = _blanks_but(LETTERS + "-"), _blanks_but(LETTERS)


def pieces(text: str, table: bytes) -> list[str]:
    """The parts of a lower-cased text that hold only what the table keeps."""
    return text.encode("ascii", "replace").translate(table).decode("ascii").split()


def term_counts_of(text: str, stop_words: frozenset[str]) -> dict[str, int]:
    """What tokens() gives, with how often."""
    return {w: n for w, n in Counter(pieces(text, TERMS)).items() if len(w) >= 4 and w not in stop_words and not w[0].isdigit()}


#: What a word may be in a phrase: a part of it, its start, its end.
PART, START, END = 1, 2, 4

_NUMBER = re.compile(r"[0-9]{4}[a-z]|[0-9]+")
_SKIPPED = frozenset(V.STOP_WORDS + V.CARDINALS + V.LOW_ANYWHERE)
_NO_START, _NO_END = frozenset((*V.LOW_STARTS, "columbia")), frozenset(V.LOW_HEADS)


class Places(dict):
    """The places of each word, kept for those seen last."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        if len(word) < 4 or word in _SKIPPED or _NUMBER.fullmatch(word):
            out = 0
        else:
            out = PART | (0 if word in _NO_START else START) | (0 if word in _NO_END else END)
        self[word] = out
        return out


PLACES = Places()


def phrases_of(words: list[str], n: int) -> Iterator[list[str]]:
    """What ngrams() gives, as words."""
    may = [*map(PLACES.__getitem__, words)]
    last = n - 1
    for i, (x, y) in enumerate(zip(may, may[last:])):
        if x & START and y & END and (n < 3 or all(may[i + 1 : i + last])):
            w = words[i : i + n]
            if len(set(w)) == n:
                yield w


def phrases_in(text: str, sizes: Iterable[int], cuts: re.Pattern | None = None) -> Iterator[str]:
    """The phrases of each part of a lower-cased text between cuts, those of one size after those of another."""
    for part in cuts.split(text) if cuts else (text,):
        words = pieces(part, WORDS)
        for n in sizes:
            yield from map(" ".join, phrases_of(words, n))


def outer_phrases(text: str) -> dict[str, int]:
    """Phrases of two and three words that lie in no longer one (of up to four words), with how often."""
    words = pieces(text, WORDS)
    two, three, four = (list(phrases_of(words, n)) for n in (2, 3, 4))
    inner = {" ".join(w[i : i + n]) for w in four for n in (2, 3) for i in range(len(w) - n + 1)} | {" ".join(w[i : i + 2]) for w in three for i in (0, 1)}
    return {p: n for p, n in Counter(map(" ".join, chain(two, three))).items() if p not in inner}


def _ends(rows: list) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32))


def _counting(of: Callable[[str], dict[str, int]]):
    @F.arrow_udf(COUNTS)
    def counts(texts: pa.Array) -> pa.Array:
        rows = [of(t) for t in texts.to_pylist()]
        terms, n = pa.array([t for r in rows for t in r], pa.string()), pa.array([x for r in rows for x in r.values()], pa.int64())
        return pa.ListArray.from_arrays(_ends(rows), pa.StructArray.from_arrays([terms, n], ["term", "tf"]))

    return counts


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def token_counts(text: Column, stop_words: Iterable[str] = V.STOP_WORDS) -> Column:
    """array<struct<term, tf>> of tokens(text)."""
    stop = frozenset(stop_words)
    return _counting(lambda t: term_counts_of(t, stop))(_low(text))


def phrase_counts(text: Column, sizes: Iterable[int], cuts: str | None = None) -> Column:
    """array<struct<term, tf>> of the phrases of so many words; none goes over a match of `cuts`."""
    sizes, pattern = tuple(sizes), cuts and re.compile(cuts)
    return _counting(lambda t: Counter(phrases_in(t, sizes, pattern)))(_low(text))


def outer_phrase_counts(text: Column) -> Column:
    return _counting(outer_phrases)(_low(text))


def first_phrases(text: Column, limit: int | None = None) -> Column:
    """The distinct phrases of two, then three words; with a limit, the first so many."""

    def first(t: str) -> list[str]:
        seen: dict[str, None] = {}
        for p in phrases_in(t, (2, 3)):
            seen[p] = None
            if len(seen) == limit:
                break
        return list(islice(seen, limit))

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        rows = [first(t) for t in texts.to_pylist()]
        return pa.ListArray.from_arrays(_ends(rows), pa.array([p for r in rows for p in r], pa.string()))

    return found(_low(text))


def inner_pairs(words: list[str]) -> set[str]:
    """Pairs of words that lie in a phrase of three words."""
    return {" ".join(w[i : i + 2]) for w in phrases_of(words, 3) for i in (0, 1)}


def phrases_with_inner(text: Column) -> Column:
    """array<struct<phrase, inner>> of the distinct phrases of two and three words, and whether a longer one holds them."""

    @F.arrow_udf("array<struct<phrase:string,inner:boolean>>")
    def found(texts: pa.Array) -> pa.Array:
        phrases, inner, ends = [], [], [0]
        for t in texts.to_pylist():
            words = pieces(t, WORDS)
            held = inner_pairs(words)
            seen = dict.fromkeys(" ".join(w) for n in (2, 3) for w in phrases_of(words, n))
            phrases += seen
            inner += [p in held for p in seen]
            ends.append(len(phrases))
        rows = pa.StructArray.from_arrays([pa.array(phrases, pa.string()), pa.array(inner, pa.bool_())], ["phrase", "inner"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return found(_low(text))


_LITTLE_TERMS, _LITTLE_WORDS, _LITTLE_HEADS = frozenset(V.LOW_TERMS), frozenset(V.NUMBER_WORDS + V.TERM_ANYWHERE), frozenset(V.TERM_HEADS)
_LITTLE = re.compile("|".join(V.LOW_TERM_PATTERNS))
_WEAK_WORDS, _WEAK_HEADS = frozenset(V.WEAK_ANYWHERE + V.DISALLOWED), frozenset(V.WEAK_HEADS)


def says_little(phrase: str) -> bool:
    """low_signal_term() of what phrases_of() gives."""
    words = phrase.split(" ")
    return phrase in _LITTLE_TERMS or words[-1] in _LITTLE_HEADS or not _LITTLE_WORDS.isdisjoint(words) or _LITTLE.search(phrase) is not None


def weak(phrase: str) -> bool:
    """weak_single() of a phrase."""
    words = phrase.split(" ")
    return words[-1] in _WEAK_HEADS or not _WEAK_WORDS.isdisjoint(words)


def phrase_uses(title: Column, text: Column, shared: Broadcast, weight: int, cuts: tuple[str, str], k: int) -> Column:
    """array<struct<phrase, tf, lone>> of what can be among a document's k best concepts: all phrases that the bits `shared` may hold, and the first of the others.

    Others are this document's alone, so among those of two words, as among those of three,
    more uses are better, then the smaller name, and no more than k of each count. lone tells
    whether a phrase counts if no other document has it: it is not weak and no longer phrase
    of title and text, set end to end, holds it.
    """
    in_title, in_text = map(re.compile, cuts)

    def of(a: str, b: str) -> Iterator[tuple[str, int, bool]]:
        tf = Counter({p: n * weight for p, n in Counter(phrases_in(a, (2, 3), in_title)).items()})
        tf.update(phrases_in(b, (2, 3), in_text))
        inner = inner_pairs(pieces(a + b, WORDS))
        left: dict[int, list[tuple[int, str]]] = {1: [], 2: []}
        for (p, n), held in zip(tf.items(), may_hold(shared.value, [*tf])):
            lone = p not in inner and not weak(p)
            if held:
                yield p, n, lone
            elif lone:
                left[p.count(" ")].append((-n, p))
        for rows in left.values():
            for n, p in islice((x for x in sorted(rows) if not says_little(x[1])), k):
                yield p, -n, True

    @F.arrow_udf("array<struct<phrase:string,tf:bigint,lone:boolean>>")
    def uses(titles: pa.Array, texts: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        for a, b in zip(titles.to_pylist(), texts.to_pylist()):
            rows += of(a, b)
            ends.append(len(rows))
        phrases, tf, lone = zip(*rows) if rows else ((), (), ())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(phrases, pa.string()), pa.array(tf, pa.int64()), pa.array(lone, pa.bool_())], ["phrase", "tf", "lone"]))

    return uses(_low(title), _low(text))
