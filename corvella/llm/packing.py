"""Conflict-constrained best-fit packing (operator 3).

Documents are cut into pieces of at most one bin and placed, longest first, in the open
bin that they fill best. Bins are kept in the order of what is left in them and carry
bitmaps of the sources and duplicate clusters they hold; the search goes on to the next
bin in that order until it meets one without a conflict.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvella.llm.columns import words
from corvella.llm.store import Cuts, shuffle_width

#: Pieces that are packed together. Bins are never shared between groups.
GROUP = 8192

#: Equal rows that are unrolled from one row at once.
COPIES = 1 << 17

PACKED = "doc_id string, piece int, first long, n_words long, bin_id long, bin_at long"


class Bins:
    """Open bins by what is left in them. levels has bit r set where a bin with r words left is open."""

    def __init__(self, capacity: int, source_slots: int):
        self.capacity, self.slots = capacity, source_slots
        self.by_left: dict[int, list[int]] = defaultdict(list)
        self.levels = 0
        self.left: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []

    def _fits(self, b: int, source: int, cluster: int) -> bool:
        return not (self.clusters[b] & cluster) and any(not plane & source for plane in self.sources[b])

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, words already in it) for a piece; source and cluster are single bits, or 0 for none."""
        above = self.levels >> size
        level = size
        while above:
            step = (above & -above).bit_length() - 1
            level += step
            for at, b in enumerate(self.by_left[level]):
                if self._fits(b, source, cluster):
                    self.by_left[level].pop(at)
                    if not self.by_left[level]:
                        self.levels &= ~(1 << level)
                    return self._fill(b, size, source, cluster)
            above >>= step + 1
            level += 1
        self.left.append(self.capacity)
        self.clusters.append(0)
        self.sources.append([0] * self.slots)
        return self._fill(len(self.left) - 1, size, source, cluster)

    def _fill(self, b: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        used = self.capacity - self.left[b]
        self.left[b] -= size
        self.clusters[b] |= cluster
        plane = next((i for i, p in enumerate(self.sources[b]) if not p & source), 0)
        self.sources[b][plane] |= source
        if self.left[b]:
            self.by_left[self.left[b]].append(b)
            self.levels |= 1 << self.left[b]
        return b, used


def pack_group(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int, source_slots: int) -> list[tuple[int, int]]:
    """(bin, place in it) of each piece, in the given order; equal clusters never share a bin, one source at most source_slots times.

    Bits are given to the sources of the group, and to clusters that it holds twice or more.
    """
    bins = Bins(capacity, source_slots)
    _, source_at = np.unique(source, return_inverse=True)
    _, cluster_at, times = np.unique(cluster, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    bit = [1 << int(number[c]) if times[c] > 1 else 0 for c in cluster_at]
    return [bins.place(int(n), 1 << int(s), c) for n, s, c in zip(size, source_at, bit, strict=True)]


def _pack(capacity: int, source_slots: int):
    def close(rows: pd.DataFrame) -> pd.DataFrame:
        # Rows equal in all of these are interchangeable, so the order does not depend on how they came.
        rows = rows.sort_values(["n_words", "doc_id", "cluster", "source", "copy"], ascending=[False, True, True, True, True], kind="stable", na_position="last")
        placed = pack_group(rows["n_words"].to_numpy(), rows["source"].to_numpy(), rows["cluster"].to_numpy(), capacity, source_slots)
        bin_, at = zip(*placed, strict=True)
        group = int(rows["grp"].iloc[0])
        return rows.assign(bin_id=np.array(bin_, dtype=np.int64) + (group << 24), bin_at=np.array(at, dtype=np.int64))[["doc_id", "piece", "first", "n_words", "bin_id", "bin_at"]]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            rest = b if rest is None or not len(rest) else pd.concat([rest, b], ignore_index=True)
            while len(rest) and rest["grp"].iloc[0] != rest["grp"].iloc[-1]:
                own = rest["grp"] == rest["grp"].iloc[0]
                yield close(rest[own])
                rest = rest[~own].reset_index(drop=True)
        if rest is not None and len(rest):
            yield close(rest)

    return each


def _unrolled(counted: DataFrame, row: list[str]) -> DataFrame:
    """A row for each of the counted copies. Those of a row that is repeated often are dealt to all tasks in blocks of COPIES."""
    block = F.col("block")
    few = counted.filter(F.col("copies") <= COPIES).withColumn("block", F.lit(0).cast("long"))
    many = counted.filter(F.col("copies") > COPIES).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    many = many.repartition(shuffle_width(counted.sparkSession), *row, "block")
    return few.unionByName(many).select(*row, F.explode(F.sequence(block * COPIES + 1, F.least("copies", (block + 1) * COPIES))).alias("copy"))


def pack(docs: DataFrame, capacity: int = 2048, source_slots: int = 2, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, first, n_words, bin_id, bin_at): where each piece of each document goes.

    A piece is words first to first + n_words - 1 of its document, at most `capacity` of them,
    and starts bin_at words into its bin. Pieces of one document may share bins with others but
    documents of equal text (a duplicate cluster) never share one, and one source is in a bin
    at most source_slots times; a null source is a source of its own. Full pieces fill bins
    alone, numbered below zero. Texts without words, null ones too, have one empty piece and no
    bin. Repeated rows and null ids are packed each. Other columns are not read; an empty table
    gives an empty result.

    Groups are cut by a hash of the document and the number among its repetitions to hold
    about `group` pieces, so a hot source, cluster or row is spread over all of them, no task
    holds more than one group (full pieces are numbered in groups of their own), and the result does not depend on how the table is stored. Bins
    are not shared between groups: at the end of each the last bins stay open.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "packing")
    row = ["doc_id", "source", "cluster", "words"]
    n = F.size(words(F.col("text"))).cast("long")
    sized = docs.select("doc_id", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("cluster"), n.alias("words"))
    # Equal rows are counted and numbered without one task having to hold them.
    counted = cuts.cut(sized.groupBy(*row).agg(F.count(F.lit(1)).alias("copies")), "sized")
    many = lambda held: F.coalesce(F.sum(F.when(held, F.col("copies"))), F.lit(0))
    groups, long_groups = (max(1, -(-n // group)) for n in counted.agg(many(F.col("words") % capacity > 0), many(F.col("words") >= capacity)).first())
    dealt = lambda n: F.pmod(F.xxhash64("doc_id", "cluster", "source", "copy"), F.lit(n))
    each = _unrolled(counted, row).withColumn("grp", dealt(groups))
    full = F.expr(f"words div {capacity}")
    wide = max(1, min(groups, shuffle_width(spark)))
    # As text, an id passes pandas whole, also beside nulls.
    last = each.filter(F.col("words") % capacity > 0).select(F.col("doc_id").cast("string").alias("doc_id"), "source", "cluster", "copy", full.cast("int").alias("piece"), (full * capacity).alias("first"), (F.col("words") % capacity).alias("n_words"), "grp")
    packed = last.repartition(wide, "grp").sortWithinPartitions("grp").mapInPandas(_pack(capacity, source_slots), PACKED).withColumn("doc_id", F.col("doc_id").cast("long"))
    # Full pieces are numbered within their group.
    long = each.filter(F.col("words") >= capacity).withColumn("grp", dealt(long_groups)).withColumn("full", full)
    before = F.sum("full").over(W.partitionBy("grp").orderBy("doc_id", "cluster", "source", "copy").rowsBetween(W.unboundedPreceding, -1))
    alone = long.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).select("doc_id", "grp", "before", F.posexplode(F.expr("sequence(1L, full)")).alias("piece", "one"))
    alone = alone.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first"), F.lit(capacity).cast("long").alias("n_words"), (-1 - (F.shiftleft("grp", 32) + F.col("before") + F.col("piece"))).alias("bin_id"), F.lit(0).cast("long").alias("bin_at"))
    zero = F.lit(0).cast("long")
    empty = each.filter(F.col("words") == 0).select("doc_id", F.lit(0).alias("piece"), zero.alias("first"), zero.alias("n_words"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_at"))
    return packed.unionByName(alone).unionByName(empty)
