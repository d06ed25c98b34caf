"""SentencePiece BPE encoding and decoding in numpy merge rounds (operator 5).

The distinct words of a batch lie end to end in flat symbol arrays. Each round finds the
smallest pair rank of each word, merges its leftmost non-overlapping occurrences at once,
and compacts the arrays, until no pair is left. Ranks are kept from round to round and
looked up anew only beside merges. Words that many rounds leave unfinished go on in
rounds over queues of ranks, which touch merged places only, so that a word of a million
characters costs about as much as the same characters in short words. Ids equal those of
the sentencepiece library for BPE models with byte fallback and the identity normaliser.
"""

import heapq
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.store import text_batches

SPACE = "▁"

#: No rank: greater than all.
NONE = 1 << 30

#: Bits of a symbol; the last one stands for no neighbour. Characters that are no pieces have symbols of their own above the pieces.
BITS = 21
NOBODY = (1 << BITS) - 1

#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

#: Rounds over all symbols, before queues of ranks take over the words that are left.
PASSES = 48

#: A word in which so many rounds had to stop short is finished pair by pair.
STOPS = 256


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at : at + size]
        at += size


class PieceModel:
    """Pieces, ranks and the merge table of a model file's bytes."""

    def __init__(self, data: bytes):
        pieces, self.prefix = [], True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("the model is not a BPE model")
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2) or own.get(4, 1) or not own.get(5, 1):
                    raise ValueError("the model's normaliser is not the identity")
                self.prefix = bool(own.get(3, 1))
        if {k for _, _, k in pieces} & {USER, UNUSED}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.pieces = [p for p, _, _ in pieces]
        self.n = len(pieces)
        normal = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        if any(a != SPACE and b == SPACE for p in normal for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece goes over the start of a word")
        if sum(k == BYTE for _, _, k in pieces) != 256:
            raise ValueError("the model has no byte fallback")
        self.bytes = [0] * 256
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.byte_of = {p: b for b, p in enumerate(self.bytes)}
        self.number = [b",%d" % i for i in range(self.n)]
        # What a piece inside a text adds to it; byte pieces are a byte each.
        self.said = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for i, (p, _, k) in enumerate(pieces)]
        order = {s: r for r, s in enumerate(sorted({s for _, s, k in pieces if k == NORMAL}, reverse=True))}
        # Symbols: the pieces, then characters that only occur inside pieces, then all other characters.
        self.symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - normal.keys()):
            self.symbol[c] = self.n + len(self.symbol) - len(normal)
        self.size = self.n + len(self.symbol) - len(normal)
        if self.size + 0x110000 >= NOBODY:
            raise ValueError("too many pieces")
        self._rank_pieces(normal, {p: order[pieces[i][1]] for p, i in normal.items()}, len(order))
        self.char = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.char_of = {i: c for c, i in self.symbol.items() if len(c) == 1}

    def _rank_pieces(self, normal: dict[str, int], rank: dict[str, int], last: int) -> None:
        """The piece of each rank, and the rank of each pair of symbols in a hash table.

        Only runs of spaces may share a rank, and it must be the last, so that they merge when nothing else can.
        """
        self.piece_of = np.full(last, -1, dtype=np.int32)
        runs = {len(p) for p in normal if set(p) == {SPACE}}
        self.tied = last - 1 if max(runs, default=0) > 1 else NONE
        for p, i in normal.items():
            if set(p) == {SPACE} and len(runs) > 1:
                if rank[p] != self.tied:
                    raise ValueError("runs of spaces do not have the last rank")
            elif self.piece_of[rank[p]] >= 0 or rank[p] == self.tied:
                raise ValueError("pieces share a rank")
            else:
                self.piece_of[rank[p]] = i
        self.run_piece = {k: normal[SPACE * k] for k in runs}
        self._time_runs(runs)
        pairs = {}
        for p in normal:
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << BITS | b] = rank[p]
        self.pair_rank = pairs
        self.bits = max(4, len(pairs).bit_length() + 2)
        self.slot_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, dtype=np.int32)
        self.shared = np.zeros(1 << self.bits, dtype=bool)
        key, value = np.array(sorted(pairs), dtype=np.int64), np.array([pairs[k] for k in sorted(pairs)], dtype=np.int32)
        slot = self._slot(key)
        _, first = np.unique(slot, return_index=True)
        self.slot_key[slot[first]], self.slot_rank[slot[first]] = key[first], value[first]
        rest = np.ones(len(key), dtype=bool)
        rest[first] = False
        self.shared[slot[rest]] = True
        # Pairs whose slot another one has; a key beyond all ends the search.
        self.rest_key, self.rest_rank = np.r_[key[rest], np.int64(1) << 62], np.r_[value[rest], NONE].astype(np.int32)

    def _time_runs(self, runs: set[int]) -> None:
        """How a run of spaces ends: whole pieces of `turn` spaces, which nothing joins, then what is listed for the rest.

        The leftmost pair is merged each time, so a run is decided from its start.
        """

        def ends(n: int) -> list[int]:
            now = [1] * n
            while (at := next((i for i in range(len(now) - 1) if now[i] + now[i + 1] in runs), None)) is not None:
                now[at : at + 2] = [now[at] + now[at + 1]]
            return now

        self.turn, self.run_ends = 1, [[]]
        if self.tied == NONE:
            return
        self.turn = max(runs)
        self.run_ends = [ends(n) for n in range(self.turn)]
        if any(ends(self.turn * k + r) != [self.turn] * k + self.run_ends[r] for k in (1, 2) for r in range(self.turn)):
            raise ValueError("runs of spaces do not end in pieces of the longest")

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or NONE."""
        key = left.astype(np.int64) << BITS | right
        slot = self._slot(key)
        same = self.slot_key[slot] == key
        found = np.where(same, self.slot_rank[slot], NONE)
        other = np.flatnonzero(self.shared[slot] & ~same)
        if len(other):
            at = np.searchsorted(self.rest_key, key[other])
            found[other] = np.where(self.rest_key[at] == key[other], self.rest_rank[at], NONE)
        return found

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and where each word's begin; words are spaces, then other characters, and not empty."""
        if not words:
            return np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word, symbol = (np.concatenate(x) for x in zip(*self._rounds(self.char[code], size), strict=True))
        order = np.argsort(word, kind="stable")
        word, symbol = self._spell(*self._join_spaces(word[order], symbol[order]))
        return symbol, np.searchsorted(word, np.arange(len(words) + 1))

    def _rounds(self, symbol: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge rounds over words of the given sizes: what is over after each round, as words' places and symbols."""
        done = []
        word = np.arange(len(size))
        start = np.cumsum(size) - size
        rank = np.full(len(symbol), NONE, dtype=np.int32)
        rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
        rank[start + size - 1] = NONE
        for _ in range(PASSES):
            least = np.minimum.reduceat(rank, start)
            going = least < self.tied
            if not going.all():
                inside = np.repeat(going, size)
                done.append((np.repeat(word[~going], size[~going]), symbol[~inside]))
                symbol, rank = symbol[inside], rank[inside]
                word, size, least = word[going], size[going], least[going]
                start = np.cumsum(size) - size
                if not len(symbol):
                    return done
            at = _every_other(np.flatnonzero(rank == np.repeat(least, size)), lambda x: x + 1)
            own = np.searchsorted(start, at, side="right") - 1
            r = least[own]
            piece = self.piece_of[r]
            # The neighbours as they are when the hit's turn comes: those to the left are merged already.
            follows = np.r_[False, (at[1:] == at[:-1] + 2) & (own[1:] == own[:-1])]
            before = np.where(at > start[own], symbol[at - 1], NOBODY)
            before[follows] = piece[np.flatnonzero(follows) - 1]
            beyond = at + 2
            after = np.where(beyond < start[own] + size[own], symbol[np.minimum(beyond, len(symbol) - 1)], NOBODY)
            left, right = self.ranks(before, piece), self.ranks(piece, after)
            able = _in_turn(np.minimum(left, right) <= r, own)
            at, own, piece, follows, left, right = (x[able] for x in (at, own, piece, follows, left, right))
            symbol[at], rank[at] = piece, right
            inner = at > start[own]
            rank[(at - 1 - follows)[inner]] = left[inner]
            stay = np.ones(len(symbol), dtype=bool)
            stay[at + 1] = False
            symbol, rank = symbol[stay], rank[stay]
            size = size - np.bincount(own, minlength=len(size))
            start = np.cumsum(size) - size
        place, symbol = self._queues(symbol, rank, size)
        return [*done, (word[place], symbol)]

    def _queues(self, symbol: np.ndarray, rank: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same rounds by queues of places, one for each rank, over all words at once: words' places and symbols at the end.

        Symbols are linked to their neighbours, so a round touches its merges only.
        """
        n = len(symbol)
        word = np.repeat(np.arange(len(size)), size)
        edge = np.r_[word[1:] != word[:-1], True]
        after = np.where(edge, n, np.arange(1, n + 1))
        before = np.where(np.r_[True, edge[:-1]], n, np.arange(-1, n - 1))
        # Place n is nobody.
        symbol, rank = np.r_[symbol, np.int32(NOBODY)], np.r_[rank, np.int32(NONE)]
        after, before, word = np.r_[after, n], np.r_[before, n], np.r_[word, len(size)]
        alive = np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        queue: list[int] = []
        stops = np.zeros(len(size), dtype=np.int64)

        def offer(places: np.ndarray) -> None:
            own = rank[places]
            places, own = places[own < self.tied], own[own < self.tied]
            order = np.argsort(own, kind="stable")
            places, own = places[order], own[order]
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
            for r, part in zip(own[cut].tolist(), np.split(places, cut[1:]), strict=True) if len(own) else ():
                if r not in waiting:
                    heapq.heappush(queue, r)
                waiting[r].append(part)

        offer(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            parts = waiting.pop(r)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = _every_other(at[rank[at] == r], after.__getitem__)
            if not len(at):
                continue
            piece = self.piece_of[r]
            dead = after[at]
            follows = np.r_[False, after[dead[:-1]] == at[1:]]
            left = self.ranks(np.where(follows, piece, symbol[before[at]]), np.full(len(at), piece))
            right = self.ranks(np.full(len(at), piece), symbol[after[dead]])
            able = _in_turn(np.minimum(left, right) <= r, word[at])
            if not able.all():
                rest = at[~able]
                stopped = np.unique(word[rest])
                stops[stopped] += 1
                for w in stopped[stops[stopped] > STOPS].tolist():
                    self._finish(w, symbol, rank, alive, word)
                offer(rest[rank[rest] == r])
                able &= rank[at] == r
                at, dead, left, right = at[able], dead[able], left[able], right[able]
                follows = follows[able]
            symbol[at], alive[dead], rank[dead] = piece, False, NONE
            after[at] = after[dead]
            before[after[at]] = at
            rank[at] = right
            rank[before[at]] = left
            # The last of a row's left ranks is its right one's; nobody has neither.
            rank[n], before[n] = NONE, n
            offer(np.unique(np.r_[at, before[at]]))
        return word[:-1][alive], symbol[:-1][alive]

    def _finish(self, w: int, symbol: np.ndarray, rank: np.ndarray, alive: np.ndarray, word: np.ndarray) -> None:
        """Merges what is left of word w pair by pair: the least rank, leftmost of equals. Its places have no ranks afterwards."""
        a, b = np.searchsorted(word, [w, w + 1])
        place = a + np.flatnonzero(alive[a:b])
        now = symbol[place].tolist()
        after, before = [*range(1, len(now)), -1], list(range(-1, len(now) - 1))
        live = [True] * len(now)
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j >= 0 and (r := self.pair_rank.get(now[i] << BITS | now[j], NONE)) < self.tied:
                heapq.heappush(queue, (r, i, now[i], now[j]))

        for i in range(len(now)):
            offer(i)
        while queue:
            r, i, x, y = heapq.heappop(queue)
            j = after[i]
            if not live[i] or now[i] != x or j < 0 or now[j] != y:
                continue
            now[i], live[j], after[i] = int(self.piece_of[r]), False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        symbol[place], alive[place], rank[a:b] = now, live, NONE

    def _join_spaces(self, word: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of single spaces as the pieces that they end in, which is what the last rank's merges come to."""
        if self.tied == NONE:
            return word, symbol
        space = symbol == self.symbol[SPACE]
        more = space[1:] & space[:-1] & (word[1:] == word[:-1])
        if not more.any():
            return word, symbol
        follows = np.r_[False, more]
        run = np.flatnonzero(~follows)
        length = np.diff(np.r_[run, len(symbol)])
        word, symbol = word[run], symbol[run]
        long = np.flatnonzero(length > 1)
        ends = {k: [self.run_piece[self.turn]] * (k // self.turn) + [self.run_piece[x] for x in self.run_ends[k % self.turn]] for k in np.unique(length[long]).tolist()}
        new = [ends[k] for k in length[long].tolist()]
        times = np.ones(len(run), dtype=np.int64)
        times[long] = [len(x) for x in new]
        symbol, word = np.repeat(symbol, times), np.repeat(word, times)
        spot = np.repeat(np.isin(np.arange(len(run)), long), times)
        symbol[spot] = [x for part in new for x in part]
        return word, symbol

    def _spell(self, word: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no pieces become the pieces of their bytes."""
        odd = np.flatnonzero(symbol >= self.n)
        if not len(odd):
            return word, symbol
        spelt = {s: [self.bytes[b] for b in (self.char_of[s] if s < self.size else chr(s - self.size)).encode("utf-8", "surrogatepass")] for s in np.unique(symbol[odd]).tolist()}
        new = [spelt[s] for s in symbol[odd].tolist()]
        times = np.ones(len(symbol), dtype=np.int64)
        times[odd] = [len(x) for x in new]
        spot = np.repeat(symbol >= self.n, times)
        word, symbol = np.repeat(word, times), np.repeat(symbol, times)
        symbol[spot] = [x for part in new for x in part]
        return word, symbol

    def words(self, text: str) -> list[str]:
        """The text with spaces as signs, cut where a word starts."""
        return WORD.findall(SPACE * self.prefix + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return self.encode_words(self.words(text))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces are read as UTF-8, control pieces are nothing, one leading space is the prefix's."""
        out = b"".join(map(self.said.__getitem__, ids))
        if self.prefix and out.startswith(b" ") and ids[0] not in self.byte_of:
            out = out[1:]
        return out.decode("utf-8", "replace")


def _every_other(at: np.ndarray, after) -> np.ndarray:
    """Of places whose pairs overlap in a row, every other one from the first."""
    joined = np.r_[False, after(at[:-1]) == at[1:]]
    index = np.arange(len(at))
    return at[(index - np.maximum.accumulate(np.where(joined, 0, index))) % 2 == 0]


def _in_turn(quick: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The hits of each word up to the first quick one, whose result has a pair that comes before the other hits."""
    if not quick.any():
        return np.ones(len(quick), dtype=bool)
    past = np.cumsum(quick) - quick
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return past == np.repeat(past[first], np.diff(np.r_[first, len(own)]))


WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(maxsize=2)
def load(data: bytes) -> PieceModel:
    return PieceModel(data)


#: Characters of new words whose symbols lie in the arrays at once.
FLAT_CHARS = 1_000_000


class Encoder:
    """Encodes whole texts, keeping words' results up to a bound, since words recur."""

    MOST_WORDS = 250_000
    LONGEST_KEPT = 48

    def __init__(self, model: PieceModel):
        self.model = model
        self.at: dict[str, int] = {}
        self.number: list[bytes] = []
        self.said: list[bytes] = []

    def _learn(self, words: list[str]) -> None:
        """The ids of each word as ",id,id", and its bytes as the pieces say them."""
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        cut = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, FLAT_CHARS))).tolist()
        for a, b in zip(cut, [*cut[1:], len(words)], strict=True):
            part = words[a:b]
            ids, start = self.model.encode_words(part)
            ids, start = ids.tolist(), start.tolist()
            number, said = list(map(self.model.number.__getitem__, ids)), list(map(self.model.said.__getitem__, ids))
            self.at.update(zip(part, range(len(self.number), len(self.number) + len(part)), strict=True))
            self.number += [b"".join(number[i:j]) for i, j in zip(start, start[1:], strict=False)]
            self.said += [b"".join(said[i:j]) for i, j in zip(start, start[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, ids joined by commas, decoded text in UTF-8) of each text."""
        cut = [self.model.words(t or "") for t in texts]
        if len(self.number) > self.MOST_WORDS:
            self.__init__(self.model)
        new = list(set().union(*cut).difference(self.at))
        self._learn(new)
        for words in cut:
            at = list(map(self.at.__getitem__, words))
            ids = b"".join(map(self.number.__getitem__, at))[1:]
            said = b"".join(map(self.said.__getitem__, at))
            yield ids.count(b",") + 1 if ids else 0, ids, said[1:] if self.model.prefix else said
        for w in new:
            if len(w) > self.LONGEST_KEPT:
                i = self.at.pop(w)
                self.number[i] = self.said[i] = b""


#: Texts that are encoded together; words are shared between them and memory is bounded.
TEXTS, CHARS = 256, 2_000_000


def _portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    now, size = [], 0
    for t in texts:
        now.append(t)
        size += len(t or "")
        if len(now) >= TEXTS or size >= CHARS:
            yield now
            now, size = [], 0
    if now:
        yield now


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, one row for each row of docs.

    Null counts as empty, which has no ids. Repeated rows and ids each have their row, other
    columns are not read, an empty table gives an empty result. A text is encoded whole
    whatever its length; its time grows with its length alone, also if it is one word. The
    model file is read here and its bytes go with the job, so only the driver needs the path.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    load(data)  # refuses models that would not give the library's ids

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(load(data))
        for texts in batches:
            rows = [(n, sha256(ids).hexdigest(), sha256(said).hexdigest()) for part in _portions(texts.tolist()) for n, ids, said in encoder.encode(part)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).astype({"n_tokens": np.int64})

    digests = F.pandas_udf(each, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return text_batches(docs).select("doc_id", digests(F.col("text")).alias("t")).select("doc_id", "t.n_tokens", "t.ids_sha256", "t.decoded_sha256")


def token_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, one row for each row of docs; null counts as empty."""
    with open(model_path, "rb") as f:
        data = f.read()

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(load(data))
        for texts in batches:
            yield pd.Series([[int(x) for x in s.split(b",")] if s else [] for part in _portions(texts.tolist()) for _, s, _ in encoder.encode(part)], dtype=object)

    return text_batches(docs).select("doc_id", F.pandas_udf(each, "array<int>")(F.col("text")).alias("ids"))
