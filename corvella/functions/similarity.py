"""String similarity that Spark lacks, of single texts and of one text with many, and blocking keys as Columns."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler(a: str | None, b: str | None) -> float:
    """Jaro-Winkler similarity with prefix weight 0.1 up to four characters; 0 for null or empty strings.

    Transpositions are halved without rounding, and the prefix counts whatever the Jaro part is.
    """
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    free: dict[str, deque[int]] = {}
    for j, c in enumerate(b):
        free.setdefault(c, deque()).append(j)
    partner = {}
    for i, c in enumerate(a):
        spots = free.get(c)
        # What lies too far back for this place does so for all later ones.
        while spots and spots[0] < i - reach:
            spots.popleft()
        if spots and spots[0] <= i + reach:
            partner[i] = spots.popleft()
    m = len(partner)
    if not m:
        return 0.0
    moved = sum(a[i] != b[j] for i, j in zip(partner, sorted(partner.values()), strict=True))
    jaro = (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: Classes that characters are counted in, and the longest texts that are compared as sets of bits.
CLASSES, WIDEST = 64, 512

#: Bytes that the matrices of pairs compared at once may take, about.
BYTES = 1 << 20


class TextTable:
    """Texts with their lengths, first four characters, and how often each class of characters occurs."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.zeros((len(texts), 4), dtype=np.uint32)
        self.bag = np.zeros((len(texts), CLASSES), dtype=np.int32)
        for i, t in enumerate(texts):
            code = points(t)
            self.start[i, : min(4, len(t))] = code[:4]
            self.bag[i] = np.bincount(code % CLASSES, minlength=CLASSES)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def able_pairs(a: TextTable, b: TextTable, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places i of a and j of b, common prefixes up to four, and bounds of the Jaro-Winkler similarity, of the pairs whose lengths, prefixes and character counts allow one of `least`."""
    filled = np.flatnonzero(b.length > 0)
    step = max(1, BYTES // (16 * max(1, len(filled))))
    for lo in range(0, len(a.texts), step):
        own = np.arange(lo, min(lo + step, len(a.texts)))
        own = own[a.length[own] > 0]
        n, m = a.length[own][:, None], b.length[filled][None, :]
        prefix, alike = np.zeros((len(own), len(filled)), dtype=np.int8), np.minimum(n, m) > 0
        for k in range(4):
            alike &= (a.start[own, k][:, None] == b.start[filled, k][None, :]) & (np.minimum(n, m) > k)
            prefix += alike
        # A class at a time, so that no array of three dimensions is made.
        most = np.zeros(prefix.shape, dtype=np.int32)
        for c in np.flatnonzero(a.bag[own].any(axis=0) & b.bag[filled].any(axis=0)):
            most += np.minimum(a.bag[own, c][:, None], b.bag[filled, c][None, :])
        bound = _bound(most, n, m, prefix)
        x, y = np.nonzero((most > 0) & (bound >= least - 1e-9))
        yield own[x], filled[y], prefix[x, y], bound[x, y]


def _bound(count: np.ndarray, n: np.ndarray, m: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The similarity of so many matches, all of them in order."""
    bound = (count / n + count / m + 1) / 3
    return bound + prefix * 0.1 * (1 - bound)


def _reaches(count: np.ndarray, n: np.ndarray, m: np.ndarray, prefix: np.ndarray, least: float) -> np.ndarray:
    return (count > 0) & (_bound(count, n, m, prefix) >= least - 1e-9)


def similar_pairs(a: TextTable, b: TextTable, least: float, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i of a and j of b of the pairs whose Jaro-Winkler similarity is at least `least`, and their similarities; wanted(i, j) says which pairs are asked for.

    What the bounds leave is compared many pairs at once, each text's places of a character
    as sets of bits. Texts of over WIDEST characters are compared one pair at a time, in
    time that grows with their length and without matrices.
    """
    compare = Comparison(a, b, least)
    for i, j, prefix, _ in able_pairs(a, b, least):
        ask = wanted(i, j)
        yield from compare(i[ask], j[ask], prefix[ask])


#: Of each text so many of the likeliest pairs are compared first, then FIRST times as many, and so on.
FIRST = 4


def best_pairs(a: TextTable, b: TextTable, least: float, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As similar_pairs(), but of each text of a all pairs of the greatest similarity are among those given, and not all others.

    The likeliest pairs of each text are compared first, in waves; a pair whose bound is below
    what its text has is never compared.
    """
    compare = Comparison(a, b, least)
    best = np.zeros(len(a.texts))
    for i, j, prefix, bound in able_pairs(a, b, least):
        ask = wanted(i, j)
        i, j, prefix, bound = i[ask], j[ask], prefix[ask], bound[ask]
        order = np.lexsort((-bound, i))
        i, j, prefix, bound = i[order], j[order], prefix[order], bound[order]
        wave = FIRST
        while len(i):
            # Places among the pairs of the same text, which stand together.
            now = np.arange(len(i)) - np.searchsorted(i, i, side="left") < wave
            for x, y, score in compare(i[now], j[now], prefix[now]):
                np.maximum.at(best, x, score)
                yield x, y, score
            left = ~now & (bound >= best[i] - 1e-9)
            i, j, prefix, bound = i[left], j[left], prefix[left], bound[left]
            wave *= FIRST


class Comparison:
    """Pairs of texts of two tables with a similarity of `least` or more, of those asked for."""

    def __init__(self, a: TextTable, b: TextTable, least: float):
        self.a, self.b, self.least, self.bits = a, b, least, None

    def __call__(self, i: np.ndarray, j: np.ndarray, prefix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a, b, least = self.a, self.b, self.least
        long = np.maximum(a.length[i], b.length[j]) > WIDEST
        if long.any():
            score = np.array([jaro_winkler(a.texts[x], b.texts[y]) for x, y in zip(i[long].tolist(), j[long].tolist(), strict=True)])
            good = score >= least
            yield i[long][good], j[long][good], score[good]
            i, j, prefix = i[~long], j[~long], prefix[~long]
        if not len(i):
            return
        self.bits = self.bits or BitTables(a, b)
        # Pairs of long texts apart, so that short ones have one word each.
        wide = -(-np.maximum(a.length[i], b.length[j]) // 64)
        for w in np.unique(wide).tolist():
            at = np.flatnonzero(wide == w)
            step = max(1, BYTES // (64 * w))
            for lo in range(0, len(at), step):
                one = at[lo : lo + step]
                yield self.bits.similar(i[one], j[one], prefix[one], w, least)


def similar(a: TextTable, i: int, b: TextTable, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of b's texts that are similar to a's text i, ascending, and their similarities."""
    found = [(j, score) for _, j, score in similar_pairs(TextTable([a.texts[i]]), b, least, lambda x, y: y >= 0)]
    at, score = (np.concatenate([np.zeros(0, t), *x]) for x, t in zip(zip(*found) if found else ((), ()), (np.int64, np.float64), strict=True))
    order = np.argsort(at)
    return at[order], score[order]


class BitTables:
    """The characters of a's and b's texts as numbers of one alphabet, and where each stands in each text of b as bits."""

    def __init__(self, a: TextTable, b: TextTable):
        short = lambda t: t if len(t) <= WIDEST else ""
        flat = [points("".join(map(short, x.texts))) for x in (a, b)]
        alphabet = np.unique(np.concatenate(flat))
        self.a, self.b = (self._coded(x, f, alphabet) for x, f in zip((a, b), flat, strict=True))
        self.n, self.m = a.length, b.length
        row, at = np.nonzero(self.b >= 0)
        letter = self.b[row, at]
        key, place = np.unique(row * len(alphabet) + letter, return_inverse=True)
        #: The set of each text and character; the first one is empty.
        self.where = np.zeros((len(b.texts), len(alphabet)), dtype=np.int32)
        self.where.reshape(-1)[key] = np.arange(1, len(key) + 1)
        self.bits = np.zeros((-(-self.b.shape[1] // 64), len(key) + 1), dtype=np.uint64)
        np.bitwise_or.at(self.bits, (at // 64, place + 1), np.uint64(1) << (at % 64).astype(np.uint64))

    @staticmethod
    def _coded(table: TextTable, flat: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
        length = np.where(table.length <= WIDEST, table.length, 0)
        out = np.full((len(length), max(1, int(length.max(initial=0)))), -1, dtype=np.int32)
        out[np.arange(out.shape[1]) < length[:, None]] = np.searchsorted(alphabet, flat)
        return out

    def similar(self, i: np.ndarray, j: np.ndarray, prefix: np.ndarray, words: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs that are similar enough, of texts of at most 64 * words characters; each character takes the first free equal one within reach."""
        order = np.argsort(-self.n[i], kind="stable")
        i, j, prefix = i[order], j[order], prefix[order]
        n, m = self.n[i], self.m[j]
        reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
        # The places within reach of a first text's place k, which move on by one with it; a word of bits is an array of its own.
        places = np.arange(64 * words)
        window = list(np.packbits(places < np.arange(64 * words + 1)[:, None], axis=1, bitorder="little").view(np.uint64)[np.minimum(reach + 1, 64 * words)].T.copy())
        free = [np.full(len(i), ~np.uint64(0)) for _ in range(words)]
        taken = np.zeros((words, len(i)), dtype=np.uint64)
        letters, row = self.a[i].T.copy(), j * self.where.shape[1]
        # Pairs come by the length of their first text, so those that have a place k stand first.
        for k, live in enumerate(np.searchsorted(-n, -np.arange(int(n.max(initial=0))), side="left").tolist()):
            carry = (k <= reach[:live]).astype(np.uint64)
            found = self.where.take(row[:live] + letters[k, :live])
            got = np.zeros(live, dtype=bool)
            for v in range(words):
                near = window[v][:live]
                if k:
                    over = near >> np.uint64(63)
                    near <<= np.uint64(1)
                    near |= carry
                    carry = over
                if v < len(self.bits):
                    spots = self.bits[v].take(found)
                    spots &= free[v][:live]
                    spots &= near
                    spots &= np.negative(spots)
                    if v:
                        spots[got] = 0
                    free[v][:live] ^= spots
                    got |= spots != 0
            taken[k // 64, :live] |= got.astype(np.uint64) << np.uint64(k % 64)
        taken, free = np.ascontiguousarray(taken.T), np.stack(free, axis=1)
        count = np.bitwise_count(taken).sum(axis=1, dtype=np.int64)
        able = np.flatnonzero(_reaches(count, n, m, prefix, least))
        i, j, prefix, n, m, count = i[able], j[able], prefix[able], n[able], m[able], count[able]
        # Matched characters of both sides, each in its own order: as many of one as of the other in every pair.
        side = lambda sets: np.nonzero(np.unpackbits(sets.view(np.uint8), axis=1, bitorder="little").view(bool))
        x, y = side(taken[able])
        _, z = side(~free[able])
        moved = np.bincount(x, weights=self.a[i[x], y] != self.b[j[x], z], minlength=len(i))
        score = (count / n + count / m + (count - moved / 2) / count) / 3
        score += prefix * 0.1 * (1 - score)
        good = score >= least
        return i[good], j[good], score[good]


def citation_year(text: Column) -> Column:
    """The first year from 1800 to 2029 that stands alone."""
    return F.nullif(F.regexp_extract(text, r"\b(1[89]\d{2}|20[0-2]\d)\b", 1), F.lit("")).try_cast("int")


def prefix_key(text: Column, n: int = 3) -> Column:
    """The first n characters, lower-cased; null for shorter texts."""
    plain = F.lower(F.trim(text))
    return F.when(F.length(plain) >= n, F.substring(plain, 1, n))
