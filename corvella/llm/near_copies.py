"""SimHash near-duplicates at a similarity (operator 6, as the pipeline's third stage uses it).

Two documents are near copies if the sets of their five-word shingles have a Jaccard index
of 0.8 or more. Sets that similar differ in about ten bits of their fingerprints, which is
too wide a radius for blocks of bits, so the blocks that tiles are cut in come from the
shingles: with the hashes of each set in one order, the first fifth of a set (and one more)
meets the first fifth of any set that similar. Within a block, fingerprints are compared
by numpy exclusive-or and bit counts as in the operator; pairs within the radius are then
held against parities of the sets, which rule out most of the pairs that only share a
passage and none that is similar, and what is left is verified on the whole sets.

The radius of 28 bits is over six deviations from the ten that a pair at the threshold is
expected to differ in; the other filters lose no pair. Shingles are held as 64-bit hashes,
and equal sets are told by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.columns import carried, restored
from corvella.llm.components import components
from corvella.llm.simhash import SEED, TILE, majority, ones
from corvella.llm.store import Cuts, few, shuffle_width, text_batches

WIDTH = 5

#: The least Jaccard index, as a fraction, and the most differing bits of fingerprints.
LEAST, RADIUS = (4, 5), 28

#: Rows of a group that are compared with one another at once.
STEP = 256


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles, A-Z lower-cased; one shingle for a text of fewer words, none without words.

    Each word is hashed once, by XXH64; a shingle's hash is mixed from those of its words.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    words = np.fromiter((digest(w, SEED) for w in found), dtype=np.uint64, count=len(found))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ out >> np.uint64(32))


def prefix(n: int) -> int:
    """How many of n hashes must be seen to meet any similar set: n less the least overlap, and one."""
    num, den = LEAST
    return n - -(-n * num // den) + 1 if n else 0


def parities(hashes: np.ndarray) -> bytes:
    """Bit i says whether an odd number of hashes is i modulo the number of bits, a power of two from twice their number up."""
    size = 128
    while size < 2 * len(hashes):
        size *= 2
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _halved(bits: np.ndarray) -> np.ndarray:
    """The parities modulo half as many bits."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, fp, bits, head): identity, size, fingerprint, parities and prefix of each row's set."""

    def each(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            h = shingles(t)
            fp = np.uint64(majority(ones(h), len(h))).astype(np.int64)
            rows.append((np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64), len(h), fp, parities(h), h[: prefix(len(h))].view(np.int64)))
        return pd.DataFrame(rows, columns=["node", "n", "fp", "bits", "head"])

    made = F.pandas_udf(each, "node long, n int, fp long, bits binary, head array<long>")
    return text_batches(docs).select("doc_id", made(F.col("text")).alias("s")).select("doc_id", "s.node", "s.n", "s.fp", "s.bits", "s.head")


#: Rows of groups that are compared by shifts, all groups at once; larger ones are compared as tiles.
SMALL = 24


class Sets:
    """Sets of blocks, those of a block (grp) together and by size: tests pairs of their places."""

    def __init__(self, rows: pd.DataFrame):
        self.node = rows["node"].to_numpy()
        self.n = rows["n"].to_numpy().astype(np.int64)
        self.fp = rows["fp"].to_numpy().view(np.uint64)
        self.pop = np.bitwise_count(self.fp).astype(np.int16)
        group = rows["grp"].to_numpy()
        self.start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.end = np.r_[self.start[1:], len(rows)]
        bits = rows["bits"].to_numpy()
        size = np.fromiter(map(len, bits), dtype=np.int64, count=len(bits))
        #: Parities of each width: of the sets that have it, and of those of twice as many, halved.
        self.size, self.sets, self.place = size, {}, {}
        for w in np.unique(np.r_[size, size // 2]).tolist():
            own, wide = np.flatnonzero(size == w), np.flatnonzero(size == 2 * w)
            both = [np.frombuffer(b"".join(bits[own]), dtype=np.uint64).reshape(len(own), -1)] if len(own) else []
            if len(wide):
                both.append(_halved(np.frombuffer(b"".join(bits[wide]), dtype=np.uint64).reshape(len(wide), -1)))
            if both:
                self.sets[w] = np.concatenate(both)
                self.place[w] = np.zeros(len(rows), dtype=np.int64)
                self.place[w][np.r_[own, wide]] = np.arange(len(own) + len(wide))

    def large(self) -> Iterator[tuple[int, int]]:
        """Where groups of over SMALL rows begin and end."""
        at = self.end - self.start > SMALL
        return zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)

    def pairs(self, wanted=None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places of groups of at most SMALL rows that may be similar; wanted(i, j) says which are asked for."""
        num, den = LEAST
        size = self.end - self.start
        ahead = np.repeat(self.end, size) - np.arange(len(self.node)) - 1
        at = np.flatnonzero((ahead > 0) & np.repeat(size <= SMALL, size))
        left, right = [at[:0]], [at[:0]]
        for d in range(1, SMALL):
            at = at[ahead[at] >= d]
            # Sizes ascend within a group, so a set that is too long for one is so for all before it.
            at = at[self.n[at] * den >= self.n[at + d] * num] if len(at) else at
            if not len(at):
                break
            near = at[np.bitwise_count(self.fp[at] ^ self.fp[at + d]) <= RADIUS]
            if wanted is not None:
                near = near[wanted(near, near + d)]
            left.append(near)
            right.append(near + d)
        i, j = np.concatenate(left), np.concatenate(right)
        fits = self.apart(i, j) * (den + num) <= (den - num) * (self.n[i] + self.n[j])
        return i[fits], j[fits]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many places parities of the sets i and j differ: never more than the sets themselves do. Widths differ by one doubling at most."""
        low = np.minimum(self.size[i], self.size[j])
        out = np.zeros(len(i), dtype=np.int64)
        for w in np.unique(low).tolist():
            at = np.flatnonzero(low == w)
            table, place = self.sets[w], self.place[w]
            # So many pairs at once that their parities stay within some megabytes.
            step = max(16, (1 << 19) // table.shape[1])
            for k in range(0, len(at), step):
                own = at[k : k + step]
                out[own] = np.bitwise_count(table[place[i[own]]] ^ table[place[j[own]]]).sum(axis=1, dtype=np.int64)
        return out

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether each of the sets i may be similar to each of j."""
        num, den = LEAST
        a, b = self.n[i][:, None], self.n[j][None, :]
        able = (np.abs(self.pop[i][:, None] - self.pop[j][None, :]) <= RADIUS) & (np.minimum(a, b) * den >= np.maximum(a, b) * num)
        able &= np.bitwise_count(self.fp[i][:, None] ^ self.fp[j][None, :]) <= RADIUS
        x, y = np.nonzero(able)
        x, y = x[i[x] != j[y]], y[i[x] != j[y]]
        fits = self.apart(i[x], j[y]) * (den + num) <= (den - num) * (self.n[i[x]] + self.n[j[y]])
        out = np.zeros(able.shape, dtype=bool)
        out[x[fits], y[fits]] = True
        return out

    def forest(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Pairs of places that span the classes of one group's sets that may be similar, from the smallest node of each on."""
        index = np.arange(lo, hi)
        paired = np.zeros(len(self.node), dtype=bool)
        for a in range(lo, hi, STEP):
            for b in range(a, hi, STEP):
                # Rows come by size: those beyond the reach of all these end the search.
                if self.n[b] * LEAST[0] > self.n[min(a + STEP, hi) - 1] * LEAST[1]:
                    break
                i, j = np.arange(a, min(a + STEP, hi)), np.arange(b, min(b + STEP, hi))
                hit = self.near(i, j)
                paired[i] |= hit.any(axis=1)
                paired[j] |= hit.any(axis=0)
        left = index[paired[lo:hi]]
        left = left[np.argsort(self.node[left], kind="stable")]
        links = []
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                at = queue.pop(0)
                hit = self.near(np.array([at]), left)[0]
                if hit.any():
                    links += [(at, int(x)) for x in left[hit]]
                    queue += left[hit].tolist()
                    left = left[~hit]
        return links


def _spanned(i: np.ndarray, j: np.ndarray, node: np.ndarray) -> list[tuple[int, int]]:
    """Of pairs of places those that span the same classes, pairs of small nodes first."""
    low, high = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for k in np.lexsort((high, low)).tolist():
        a, b = int(i[k]), int(j[k])
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            out.append((a, b))
    return out


def _whole_groups(work):
    """A function over batches of rows with those of a grp together, from one over rows of whole groups."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            last = b["grp"].to_numpy() == b["grp"].iloc[-1]
            cut = len(b) - int(last[::-1].argmin()) if not last.all() else 0
            rest = b.iloc[cut:].reset_index(drop=True)
            if cut and (made := work(b.iloc[:cut])) is not None:
                yield made
        if rest is not None and len(rest) and (made := work(rest)) is not None:
            yield made

    return each


def _named(rows: pd.DataFrame, sets: Sets, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"home": rows["home"].to_numpy()[i], "u": np.minimum(sets.node[i], sets.node[j]), "v": np.maximum(sets.node[i], sets.node[j])})


def _spanning(rows: pd.DataFrame) -> pd.DataFrame | None:
    """(home, u, v): pairs that span what may be similar in each group."""
    sets = Sets(rows)
    links = _spanned(*sets.pairs(), sets.node)
    for lo, hi in sets.large():
        links += sets.forest(lo, hi)
    return _named(rows, sets, *np.array(links).T) if links else None


def _nearest(most: int):
    """(home, u, v, more): for each set of a group those of other classes that it may be similar to, and in large groups the nearest `most` and whether it has others."""

    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        part = rows["part"].to_numpy()
        sets = Sets(rows)
        i, j = sets.pairs(lambda a, b: part[a] != part[b])
        out = [_named(rows, sets, i, j).assign(more=False)] if len(i) else []
        for lo, hi in sets.large():
            if (part[lo:hi] == part[lo]).all():
                continue
            for a in range(lo, hi, STEP):
                own, index = np.arange(a, min(a + STEP, hi)), np.arange(lo, hi)
                hit = sets.near(own, index) & (part[own][:, None] != part[index][None, :])
                for x in np.flatnonzero(hit.any(axis=1)):
                    others = index[hit[x]]
                    if more := len(others) > most:
                        others = others[np.argsort(sets.apart(np.full(len(others), own[x]), others), kind="stable")[:most]]
                    out.append(_named(rows, sets, np.full(len(others), own[x]), others).assign(more=more))
        return pd.concat(out).drop_duplicates() if out else None

    return work


def _members(nodes: DataFrame) -> DataFrame:
    """(home, node, c): the sets that share a hash of their prefixes, and how many they are. Of hashes that the same sets share one counts."""
    tokens = nodes.select(F.explode("head").alias("token"), "node")
    # Sums of so few bits that they cannot overflow.
    mark = lambda seed: F.sum(F.shiftrightunsigned(F.xxhash64("node", F.lit(seed)), 28))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c"), mark(3).alias("s"), mark(5).alias("s2")).filter("c > 1")
    groups = shared.groupBy("c", "s", "s2").agg(F.min("token").alias("token"))
    return tokens.join(groups, "token").select(F.col("token").alias("home"), "node", "c")


def _dealt(members: DataFrame, nodes: DataFrame, tile: int, *more: str) -> DataFrame:
    """The members of each group with what is known of their sets, by group; groups of over `tile` are cut into tiles, and each two of those are a group of their own."""
    tiles = F.ceil(F.col("c") / tile).cast("int")
    spread = members.withColumn("tiles", tiles).withColumn("t", F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int")).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("home", F.xxhash64("home", F.least("t", "mate"), F.greatest("t", "mate")).alias("grp"), "node", *more)
    known = spread.join(nodes.select("node", "n", "fp", "bits"), "node")
    return known.repartition(shuffle_width(nodes.sparkSession), "grp").sortWithinPartitions("grp", "n", "node")


def _verified(cuts: Cuts, pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets have the least Jaccard index or more. Only their texts are read into whole sets."""
    num, den = LEAST

    def each(texts: pd.Series) -> pd.DataFrame:
        made = [shingles(t) for t in texts]
        return pd.DataFrame({"node": [np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64) for h in made], "hashes": [h.view(np.int64) for h in made]})

    asked = cuts.cut(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "asked")
    ids = cuts.cut(nodes.join(asked, "node", "left_semi").select(F.col("rep").alias("id")).distinct(), "ids")
    texts = docs.select("doc_id", "text").join(few(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = cuts.cut(texts.select(F.pandas_udf(each, "node long, hashes array<long>")(F.col("text")).alias("x")).select("x.node", "x.hashes").join(asked, "node", "left_semi").dropDuplicates(["node"]), "sets")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_set"))
    both = pairs.join(side("v"), "v").join(side("u"), "u")
    overlap = F.size(F.array_intersect("u_set", "v_set"))
    out = cuts.cut(both.filter(overlap * (num + den) >= (F.size("u_set") + F.size("v_set")) * num).select("u", "v").distinct(), "links")
    cuts.drop(sets)
    return out


def near_copies(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(doc_id, node, component_id): the smallest doc_id reachable over near copies.

    Equal sets are one node, and sets are the nodes of the graph, so rows with a null id link
    others; a class that only null ids have gets a null component. Texts without words are
    equal. Repeated rows stay. An empty table gives an empty result.

    Each group first gives pairs that span what may be similar in it; once these are verified,
    only sets that are still in different classes are compared again, nearest ones first, in
    rounds until none has others. No step makes rows for all pairs of a group.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "near-copies")
    prints = cuts.cut(sketches(docs), "prints")
    nodes = cuts.cut(prints.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "fp", "bits", "head")]), "nodes")
    first = cuts.cut(_dealt(_members(nodes), nodes, tile).mapInPandas(_whole_groups(_spanning), "home long, u long, v long"), "spanning")
    found = cuts.cut(components(_verified(cuts, cuts.cut(first.select("u", "v").distinct(), "pairs"), nodes, docs)), "found")
    # What may be similar to something in its group.
    members = cuts.cut(first.select("home", F.explode(F.array("u", "v")).alias("node")).distinct(), "members")
    most = 4
    while True:
        placed = members.join(found, "node", "left").select("home", "node", F.coalesce("component", "node").alias("part"))
        mixed = placed.groupBy("home").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count(F.lit(1)).alias("c")).filter("a <> b").select("home", "c")
        open_ = cuts.cut(_dealt(placed.join(mixed, "home"), nodes, tile, "part").mapInPandas(_whole_groups(_nearest(most)), "home long, u long, v long, more boolean"), "open")
        if open_.isEmpty():
            break
        links = _verified(cuts, cuts.cut(open_.select("u", "v").distinct(), "pairs"), nodes, docs)
        if not links.isEmpty():
            found = cuts.cut(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links)), "found")
        again = cuts.cut(open_.filter("more").select("home").distinct(), "again")
        if again.isEmpty():
            break
        members = cuts.cut(members.join(again, "home", "left_semi"), "members")
        most *= 4
    least = nodes.select("node", "rep").join(found, "node").groupBy("component").agg(F.min("rep").alias("least"))
    labels = found.join(least, "component").select("node", "least")
    classes = cuts.cut(nodes.select("node", "rep").join(labels, "node", "left").select("node", F.coalesce("least", "rep").alias("component_id")), "classes")
    return prints.select("doc_id", "node").join(classes, "node", "left").select("doc_id", "node", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the rows whose class holds a smaller doc_id. Of rows that repeat a doc_id all or none stay.

    Rows with a null id stay. The ids to drop are narrow: they go to the texts, unless they are many.
    """
    cuts = Cuts(docs.sparkSession, "keep-first")
    gone = cuts.cut(near_copies(docs).filter(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    rows = carried(docs, __id=F.col("doc_id"))
    return restored(rows.join(few(gone), F.col("__id") == F.col("__gone"), "left_anti"), docs.columns)
