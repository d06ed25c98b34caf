"""SimHash near-duplicates (operator 6).

Fingerprints of word shingles are compared exactly, with numpy exclusive-or and bit
counts, tile against tile; tile pairs whose population counts differ by more than the
radius are skipped. Comparing every tile with every other is quadratic in the corpus, so
tiles are cut inside pigeonhole blocks: of `radius + 2` blocks of the 64 bits, two
fingerprints within the radius agree on two at least, and each pair of blocks keys one
partition of the fingerprints. Blocks that are still large are parted once more by the
bits that are left, five times over: of five runs of those, a pair agrees on one. No link
is lost by it.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.llm.columns import carried, restored
from corvella.llm.components import components
from corvella.llm.store import Cuts, few, shuffle_width, text_batches

SEED = 42

#: Fingerprints of one tile. Larger blocks are cut into tiles, and each pair of tiles is one group of rows.
TILE = 2048

#: Shingles whose bits are counted at once, to bound memory on very long texts.
CHUNK = 1 << 16


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(count: np.ndarray, n: int) -> int:
    """The fingerprint: a bit is 1 if over half of the n hashes have it."""
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash over XXH64 of the text's word shingles, A-Z lower-cased; 0 for a text without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < width:
        found, width = [b" ".join(found)], 1
    n = len(found) - width + 1
    count = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = found[at : min(n, at + CHUNK) + width - 1]
        count += ones(np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))), dtype=np.uint64))
    return majority(count, n)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null and empty texts have 0."""

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, width) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64))

    return text_batches(docs).select("doc_id", F.pandas_udf(each, "long")(F.col("text")).alias("fp"))


def _runs(bits: list[int], n: int) -> list[int]:
    """Masks of n runs of the given bits."""
    cuts = [round(len(bits) * i / n) for i in range(n + 1)]
    return [sum(1 << x for x in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span the components of a tile pair: each fingerprint with a partner is compared with those not yet reached."""
    pop = np.bitwise_count(fp).astype(np.int16)
    order = np.argsort(pop, kind="stable")
    fp, pop = fp[order], pop[order]
    n = len(fp)
    # Which rows have any partner at all: tiles of 256 against tiles whose population counts are near enough.
    lone = np.ones(n, dtype=bool)
    step = 256
    for a in range(0, n, step):
        for b in range(a, n, step):
            if pop[b] - pop[min(a + step, n) - 1] > radius:
                break
            near = np.bitwise_count(fp[a : a + step, None] ^ fp[None, b : b + step]) <= radius
            if a == b:
                np.fill_diagonal(near, False)
            lone[a : a + step] &= ~near.any(axis=1)
            lone[b : b + step] &= ~near.any(axis=0)
    left = np.flatnonzero(~lone)
    links: list[tuple[int, int]] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = np.bitwise_count(fp[left] ^ fp[at]) <= radius
            if hit.any():
                new = left[hit]
                links += [(order[at], order[x]) for x in new]
                queue += list(new)
                left = left[~hit]
    return links


def _compare(radius: int, small: int = 24):
    """Links among rows (grp, fp), those of a group together: small groups all at once by shifted comparison, others as tiles."""

    def whole(b: pd.DataFrame) -> pd.DataFrame:
        fp = b["fp"].to_numpy().view(np.uint64)
        group = b["grp"].to_numpy()
        n = len(fp)
        if not n:
            return pd.DataFrame({"u": [], "v": []}, dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, n])
        us, vs = [], []
        pop = np.bitwise_count(fp).astype(np.int16)
        big = np.repeat(sizes > small, sizes)
        ahead = np.repeat(starts + sizes, sizes) - np.arange(n) - 1
        at = np.flatnonzero((ahead >= 1) & ~big)
        d = 1
        while len(at):
            at = at[ahead[at] >= d]
            near = at[np.abs(pop[at] - pop[at + d]) <= radius] if len(at) else at
            if len(near):
                near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= radius]
                us.append(fp[near])
                vs.append(fp[near + d])
            d += 1
        for s, k in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            own = slice(s, s + k)
            if links := _forest(fp[own], radius):
                x, y = np.array(links).T
                us.append(fp[own][x])
                vs.append(fp[own][y])
        if not us:
            return pd.DataFrame({"u": [], "v": []}, dtype=np.int64)
        return pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)}).drop_duplicates()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            last = b["grp"].to_numpy() == b["grp"].iloc[-1]
            cut = len(b) - int(last[::-1].argmin()) if not last.all() else 0
            rest = b.iloc[cut:].reset_index(drop=True)
            if cut:
                yield whole(b.iloc[:cut].reset_index(drop=True))
        if rest is not None:
            yield whole(rest)

    return each


def _sizes(keyed: DataFrame, tile: int) -> DataFrame:
    """(block, tiles) of the blocks of over `tile` rows."""
    return keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile).select("block", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))


def near_links(prints: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(u, v): links that span the classes of the distinct fingerprints prints(fp), within `radius` bits.

    A block of over `tile` fingerprints is parted by runs of its other bits; what is still
    larger is cut by fingerprint hash into tiles, and each pair of tiles is compared as a
    group of its own. So no task gathers more than two tiles at once.
    """
    spark = prints.sparkSession
    cuts = Cuts(spark, "links")
    masks = _runs(list(range(64)), radius + 2)
    pairs = list(combinations(masks, 2))
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(_long(a | b)).alias("bits")) for k, (a, b) in enumerate(pairs)])
    keyed = prints.select("fp", F.explode(keys).alias("key")).select("fp", "key.k", F.xxhash64("key.k", "key.bits").alias("block"))
    large = cuts.cut(_sizes(keyed, tile), "large")
    if large.isEmpty():
        dealt = keyed.select("fp", F.col("block").alias("grp"))
    else:
        marked = keyed.join(large, "block", "left")
        parts = [_runs([x for x in range(64) if not (a | b) >> x & 1], radius + 1) for a, b in pairs]
        part = F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(_long(m)).alias("bits")) for i, m in enumerate(p)]) for p in parts])
        parted = marked.filter("tiles is not null").select("fp", "block", F.explode(F.get(part, F.col("k"))).alias("x")).select("fp", F.xxhash64("block", "x.i", "x.bits").alias("block"))
        tiled = parted.join(_sizes(parted, tile), "block", "left").withColumn("t", F.pmod(F.xxhash64("fp", F.lit(7)), F.coalesce("tiles", F.lit(1))).cast("int"))
        # Every tile with itself and with each other tile of its block.
        mates = F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
        spread = tiled.withColumn("mate", F.explode(mates)).select("fp", F.xxhash64("block", F.least("t", "mate"), F.greatest("t", "mate")).alias("grp"))
        dealt = marked.filter("tiles is null").select("fp", F.col("block").alias("grp")).unionByName(spread)
    return dealt.repartition(shuffle_width(spark), "grp").sortWithinPartitions("grp").mapInPandas(_compare(radius), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most `radius` differing bits.

    Equal fingerprints are one node, and fingerprints are the nodes of the graph, so that
    rows with a null id link others like any row; a class that only null ids have gets a null
    component. Texts without words have fingerprint 0 and link like others. Repeated rows
    stay.
    """
    cuts = Cuts(docs.sparkSession, "simhash")
    prints = cuts.cut(fingerprints(docs, width), "prints")
    reps = cuts.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    found = cuts.cut(components(near_links(reps.select("fp"), radius)), "found")
    linked = reps.join(found, reps["fp"] == found["node"]).groupBy("component").agg(F.min("rep").alias("least"))
    least = found.join(linked, "component").select(F.col("node").alias("fp"), "least")
    classes = cuts.cut(reps.join(least, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "classes")
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """docs, all columns, without the rows whose class holds a smaller doc_id. Of rows that repeat a doc_id all or none stay.

    Rows with a null id stay. The ids to drop are narrow: they go to the texts, unless they are many.
    """
    cuts = Cuts(docs.sparkSession, "keep-first")
    gone = cuts.cut(near_duplicates(docs, width, radius).filter(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    rows = carried(docs, __id=F.col("doc_id"))
    return restored(rows.join(few(gone), F.col("__id") == F.col("__gone"), "left_anti"), docs.columns)


def simhash_digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs.

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows and
    ids each have their row; a class's smallest id is its component, null where only null ids
    are in it. Other columns are not read; an empty table gives an empty result.
    """
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
