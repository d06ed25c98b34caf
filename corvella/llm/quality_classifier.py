"""Quality classifier with learned subword embeddings (operator 2).

A document is the average of the learned vectors of its words and their character
n-grams, hashed into buckets; a softmax over two classes scores it. Training is numpy
stochastic gradient descent on the driver, over a bounded sample of labelled rows.
"""

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.llm.store import text_batches

#: The pseudo word that stands for a word equal to the one before it. No word holds a blank.
DOUBLED = b" ="


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows that the fit sees at most, those of the smallest id hashes, with whole texts of any length."""

    sample: int = 4000
    buckets: int = 1 << 17
    dim: int = 8
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 8
    rate: float = 0.5
    doubled_weight: int = 8
    seed: int = 7


def features(words: list[bytes], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of many words at once, as (word's place, bucket) arrays: whole words, then the character n-grams of each length.

    Words, in UTF-8 and without blanks, have their ends marked; n-grams are of code points and
    are hashed as numbers, all at once.
    """
    if not words:
        return []
    found = [(np.arange(len(words)), np.fromiter((crc32(w) for w in words), dtype=np.int64, count=len(words)) % s.buckets)]
    text = "<" + b"> <".join(words).decode("utf-8", "surrogatepass") + ">"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    blank = code == 32
    word = np.cumsum(blank)
    for n in s.grams:
        last = len(code) - n + 1
        if last < 1:
            continue
        at = np.flatnonzero((word[:last] == word[n - 1 :]) & ~blank[:last])
        mix = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            mix = (mix ^ code[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(29)
        found.append((word[at], (mix % np.uint64(s.buckets)).astype(np.int64)))
    return found


#: Texts whose words are looked up together.
TEXTS, CHARS = 512, 1_000_000


def portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    now, size = [], 0
    for t in texts:
        now.append(t)
        size += len(t or "")
        if len(now) >= TEXTS or size >= CHARS:
            yield now
            now, size = [], 0
    if now:
        yield now


def word_counts(text: str | None) -> Counter:
    """Words of a whole text, in UTF-8, with their counts, and how many equal their predecessor.

    Bytes are split at just the six blanks.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    counts = Counter(words)
    if doubled := sum(map(eq, words, words[1:])):
        counts[DOUBLED] = doubled
    return counts


@dataclass
class Model:
    """gain: each bucket's pull towards class 1 against class 0; bias: that of a text without features."""

    settings: Settings
    gain: np.ndarray
    bias: float


def weighted(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's features, ascending, and their shares, as 32-bit numbers; both empty for a text without words."""
    counts = word_counts(text)
    doubled = counts.pop(DOUBLED, 0)
    times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    total = np.zeros(s.buckets)
    for place, bucket in features(list(counts), s):
        total += np.bincount(bucket, weights=times[place], minlength=s.buckets)
    total[crc32(DOUBLED) % s.buckets] += doubled * s.doubled_weight
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), (total[ids] / max(total.sum(), 1)).astype(np.float32)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], s: Settings = Settings()) -> Model:
    """Fits vectors and the softmax by gradient descent, one document (as weighted() gives it) a step, with a falling rate.

    Without rows, or with one class only, the score is constant: the smoothed share of class 1.
    """
    share = (sum(labels) + 1) / (len(labels) + 2)
    bias = math.log(share / (1 - share))
    if len(set(labels)) < 2:
        return Model(s, np.zeros(s.buckets, dtype=np.float32), bias)
    rng = np.random.default_rng(s.seed)
    vectors = (rng.random((s.buckets, s.dim), dtype=np.float32) - 0.5) / s.dim
    out = np.zeros((2, s.dim), dtype=np.float32)
    offset = np.array([0.0, bias], dtype=np.float32)
    steps, done = s.epochs * len(docs), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(docs)):
            rate = s.rate * (1 - done / steps)
            done += 1
            ids, weight = docs[i][0], docs[i][1][:, None]
            mean = (vectors[ids] * weight).sum(axis=0)
            z = out @ mean + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            offset -= 0.1 * rate * p
            # A document's average moves by the whole step, whatever its length.
            if len(ids):
                vectors[ids] -= rate * weight / (weight * weight).sum() * back
    return Model(s, vectors @ (out[1] - out[0]), float(offset[1] - offset[0]))


class Scorer:
    """Scores texts; words' pulls are kept, up to a bound, since words recur."""

    MOST_WORDS = 200_000
    LONGEST_KEPT = 64

    def __init__(self, model: Model):
        self.model = model
        self.gain = model.gain.astype(np.float64)
        s = model.settings
        self.doubled = (float(self.gain[crc32(DOUBLED) % s.buckets]) * s.doubled_weight, s.doubled_weight)
        self.kept: dict[bytes, tuple[float, int]] = {}

    def learn(self, words: list[bytes]) -> dict[bytes, tuple[float, int]]:
        """The summed pull and the number of each word's features; a word's sum does not depend on the others."""
        pull, number = np.zeros(len(words)), np.zeros(len(words), dtype=np.int64)
        for place, bucket in features(words, self.model.settings):
            pull += np.bincount(place, weights=self.gain[bucket], minlength=len(words))
            number += np.bincount(place, minlength=len(words))
        return dict(zip(words, zip(pull.tolist(), number.tolist(), strict=True), strict=True))

    def scores(self, texts: list[str | None]) -> Iterator[float]:
        for part in portions(texts):
            counted = [word_counts(t) for t in part]
            if len(self.kept) > self.MOST_WORDS:
                self.kept.clear()
            made = self.learn(list(set().union(*counted).difference(self.kept, (DOUBLED,))))
            made[DOUBLED] = self.doubled
            self.kept.update((w, x) for w, x in made.items() if len(w) <= self.LONGEST_KEPT)
            for counts in counted:
                total, n = 0.0, 0
                # Summed in the words' order, so a text has one score wherever it is scored.
                for w, k in counts.items():
                    g, m = self.kept.get(w) or made[w]
                    total += k * g
                    n += k * m
                z = self.model.bias + (total / n if n else 0.0)
                yield 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def held_out(doc_id: Column) -> Column:
    """One in five ids, by the checksum of its digits; a null id counts as no digits."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learns from labels(doc_id, quality) outside the held-out fifth, at most s.sample of them.

    Rows with a null id or label are no labels; of several labels for one id the largest
    counts, and of several texts for one id the first in their order. The sample's ids are
    broadcast (s.sample rows at most) to the scan of the texts; their features are counted
    where the texts are, and only those come to the driver.
    """
    known = labels.select("doc_id", "quality").dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("__quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)

    def each(texts: pd.Series) -> pd.DataFrame:
        made = [weighted(t, s) for t in texts]
        return pd.DataFrame({"ids": [i.tobytes() for i, _ in made], "shares": [w.tobytes() for _, w in made]})

    one = text_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__quality").agg(F.min("text").alias("text"))
    counted = one.select("doc_id", "__quality", F.pandas_udf(each, "ids binary, shares binary")("text").alias("x"), F.xxhash64("doc_id").alias("h"))
    rows = sorted(counted.select("doc_id", "__quality", "x.ids", "x.shares", "h").collect(), key=lambda r: (r["h"], r["doc_id"]))
    return train([(np.frombuffer(r["ids"], dtype=np.int32), np.frombuffer(r["shares"], dtype=np.float32)) for r in rows], [int(r["__quality"] > 0) for r in rows], s)


def score(model: Model):
    """A function from a text column to its score; null and empty texts have the score of no features."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series(list(scorer.scores(texts.tolist())), dtype="float64")

    return F.pandas_udf(each, "double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least `threshold`, with all their columns."""
    return text_batches(docs).filter(score(model)(F.col("text")) >= threshold)


def quality_scores(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.3 up): one row for each row of docs.

    Null, empty and blank texts have the score of no features, which is the bias alone. Equal
    texts have equal scores, so repeated rows do; a null id is held out or not as if it had no
    digits. Other columns are not read; an empty table gives an empty result.
    """
    out = text_batches(docs).select("doc_id", score(fit(docs, labels, s))(F.col("text")).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
