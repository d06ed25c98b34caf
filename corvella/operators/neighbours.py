"""Exact nearest neighbours, by blocks of vectors that rings around pivots bound.

A vector belongs to its nearest pivot, and a pivot's vectors are cut into blocks by their
distance to it. A block knows how far its vectors are from every pivot at least and at most,
so the triangle inequality tells which blocks can hold nearer neighbours than those that a
first pass within blocks has found. A pair of blocks is one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.operators.cut import stored, tidied

#: Vectors of a block, bundles of blocks that search together, and blocks that a bundle meets at once. A block is sent once to each bundle, so what is sent grows with the vectors times BUNDLES.
BLOCK, BUNDLES, MEET = 1024, 16, 64

#: Numbers that are held at once, about, and the tile of a product: small enough to stay in a core's cache.
HELD, ROWS, WIDE = 1 << 22, 256, 1024

#: Pivots come to the driver: one for each PER_PIVOT vectors, MOST_PIVOTS at most.
PER_PIVOT, MOST_PIVOTS = 512, 256

#: Distances are rounded to so many places, so that they do not depend on the shape of a product.
PLACES = 9

#: Distances from matrix products may be off by so much of the longest vector.
ROOM = 1e-6

PACKED = "block string, pivot int, ids binary, rows binary, groups binary, cores binary, bounds binary, near array<double>, far array<double>, bound double, wanting boolean"
FOUND = "id long, other long, weight double"


class Blocks:
    """points(id, vec array<double>) dealt to blocks once; pack() adds what a search needs of each point."""

    def __init__(self, points: DataFrame, block: int = BLOCK):
        self.spark, self.block = points.sparkSession, block
        points = stored(points.select("id", "vec"))
        self.n, longest = points.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
        # Room for rounding in products.
        self.room = ROOM * (longest or 0.0) ** 0.5
        count = max(1, min(MOST_PIVOTS, self.n // PER_PIVOT))
        chosen = [r["vec"] for r in points.orderBy(F.xxhash64("id"), "id").limit(count).collect()]
        self.pivots = np.array(chosen, dtype=float)
        pivots = self.pivots

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = np.stack(b["vec"].to_list())
                to = _distances(rows, pivots)
                at = to.argmin(axis=1)
                yield b.assign(pivot=at.astype(np.int32), away=to[np.arange(len(rows)), at])

        if not self.n:
            self.dealt = points.selectExpr("id", "vec", "0 AS pivot", "'' AS block")
            return
        placed = stored(points.mapInPandas(place, "id long, vec array<double>, pivot int, away double"))
        # Rings: a pivot's vectors cut at quantiles of their distance. One row a pivot.
        cells = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.percentile_approx("away", [i / 64 for i in range(1, 64)], 1000)).alias("cuts"))
        rings = F.ceil(F.col("n") / block)
        step = F.greatest(F.lit(1), F.ceil(F.lit(64) / rings))
        ring = F.expr("size(filter(cuts, c -> c < away))")
        rung = placed.join(F.broadcast(cells), "pivot").select("id", "vec", "pivot", F.floor(ring / step).alias("ring"))
        # Vectors at one distance, or more than 64 rings can part, are parted by their ids.
        parts = rung.groupBy("pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / (2 * block)).alias("parts"))
        part = F.pmod(F.xxhash64("id"), F.col("parts"))
        self.dealt = stored(rung.join(parts, ["pivot", "ring"]).select("id", "vec", "pivot", F.concat_ws("-", F.col("pivot").cast("string"), F.col("ring").cast("string"), part.cast("string")).alias("block")))
        self.spans = self._spans()

    def pack(self, known: DataFrame) -> DataFrame:
        """One row a block; known(id, group, core, bound): points of one group are not neighbours, core is the least weight of a point's edges, and those with a bound search for something nearer."""
        pivots = self.pivots

        def packed(b: pd.DataFrame) -> pd.DataFrame:
            rows, bounds = np.stack(b["vec"].to_list()), b["bound"].to_numpy(float)
            to, want = _distances(rows, pivots), ~np.isnan(bounds)
            side = to[want] if want.any() else to[:0]
            return pd.DataFrame(
                {
                    "block": b["block"].iloc[:1],
                    "pivot": b["pivot"].iloc[0],
                    "ids": b["id"].to_numpy(np.int64).tobytes(),
                    "rows": rows.tobytes(),
                    "groups": b["group"].to_numpy(np.int64).tobytes(),
                    "cores": b["core"].to_numpy(float).tobytes(),
                    "bounds": bounds.tobytes(),
                    # How far the searching points are from each pivot.
                    "near": [side.min(axis=0) if len(side) else np.zeros(0)],
                    "far": [side.max(axis=0) if len(side) else np.zeros(0)],
                    "bound": float(bounds[want].max()) if want.any() else 0.0,
                    "wanting": bool(want.any()),
                }
            )

        return stored(self.dealt.join(known, "id").groupBy("block").applyInPandas(packed, PACKED))

    def _spans(self) -> DataFrame:
        """(pivot, other, lo, hi): how far a block's vectors are from their pivot. One row a block."""
        pivots = self.pivots

        def span(b: pd.DataFrame) -> pd.DataFrame:
            at = int(b["pivot"].iloc[0])
            to = _distances(np.stack(b["vec"].to_list()), pivots[at : at + 1])[:, 0]
            return pd.DataFrame({"pivot": [at], "other": b["block"].iloc[:1], "lo": to.min(), "hi": to.max()})

        return stored(self.dealt.groupBy("block").applyInPandas(span, "pivot int, other string, lo double, hi double"))


def _distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    d2 = (rows * rows).sum(axis=1)[:, None] + (others * others).sum(axis=1)[None, :] - 2 * (rows @ others.T)
    return np.sqrt(np.maximum(0, d2))


def _exact(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of points as every block computes them, rounded."""
    return np.round(np.sqrt(((others - rows) ** 2).sum(axis=1)), PLACES)


class _Best:
    """The k edges of least weight of some points, out of candidates that come in turn; what is sure to be beyond them is dropped as they come."""

    def __init__(self, k: int, room: float, rows: np.ndarray, ids: np.ndarray, cores: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, other: np.ndarray, core: np.ndarray):
        self.k, self.room, self.rows, self.ids, self.cores, self.bounds = k, room, rows, ids, cores, bounds
        self.vectors, self.other, self.core = vectors, other, core
        self.square = (rows * rows).sum(axis=1)
        # With room for rounding; what is left is measured again.
        self.limit = bounds + 2 * room
        self.i, self.j, self.loose = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def asked(self) -> np.ndarray:
        return (self.square - self.limit * self.limit) / 2

    def add(self, i: np.ndarray, j: np.ndarray, products: np.ndarray) -> None:
        away = np.sqrt(np.maximum(0, self.square[i] - 2 * products)) - self.room
        loose = np.maximum(np.maximum(away, self.cores[i]), self.core[j])
        fine = loose <= self.bounds[i] + self.room
        self.i, self.j, self.loose = (np.concatenate([x, y[fine]]) for x, y in ((self.i, i), (self.j, j), (self.loose, loose)))
        if np.bincount(self.i, minlength=1).max() > 4 * self.k:
            self._keep(np.lexsort((self.loose, self.i)))
            first = np.searchsorted(self.i, np.arange(len(self.ids)))
            have = np.bincount(self.i, minlength=len(self.ids)) >= self.k
            least = np.full(len(self.ids), np.inf)
            least[have] = self.loose[first[have] + self.k - 1]
            self._keep(self.loose <= least[self.i] + 4 * self.room)
            self.limit = np.minimum(self.limit, least + 5 * self.room)
            if len(self.i) > 8 * self.k * len(self.ids):
                # Many at one distance: their ids decide.
                self._settle()

    def _keep(self, at: np.ndarray) -> None:
        self.i, self.j, self.loose = self.i[at], self.j[at], self.loose[at]

    def _settle(self) -> np.ndarray:
        """The weights of the k best of each point, which alone are kept."""
        i, j = self.i, self.j
        step = max(1, HELD // max(1, self.rows.shape[1]))
        away = [_exact(self.rows[i[n : n + step]], self.vectors[j[n : n + step]]) for n in range(0, len(i), step)]
        weight = np.maximum(np.maximum(np.concatenate([np.zeros(0), *away]), self.cores[i]), self.core[j])
        low, high = np.minimum(self.ids[i], self.other[j]), np.maximum(self.ids[i], self.other[j])
        order = np.lexsort((high, low, weight, i))
        order = order[weight[order] <= self.bounds[i[order]]]
        placed = i[order]
        at = order[np.arange(len(order)) - np.searchsorted(placed, placed) < self.k]
        self._keep(at)
        return weight[at]

    def found(self) -> pd.DataFrame:
        weight = self._settle()
        return pd.DataFrame({"id": self.ids[self.i], "other": self.other[self.j], "weight": weight})


def _search(k: int, room: float):
    """The k edges of least weight of each searching point of the left blocks, within its bound, to points of other groups in those of the right blocks that name its block or none."""

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a in left.to_dict("records"):
            mine = right[[a["block"] in x for x in right["lefts"]]] if "lefts" in right else right
            if len(mine):
                out += one(a, mine)
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "weight": []})

    def one(a: dict, right: pd.DataFrame) -> list[pd.DataFrame]:
        ids, groups, cores, bounds = (np.frombuffer(a[c], t) for c, t in (("ids", np.int64), ("groups", np.int64), ("cores", float), ("bounds", float)))
        rows = np.frombuffer(a["rows"]).reshape(len(ids), -1)
        held = [np.concatenate([np.frombuffer(x, t) for x in right[c]]) for c, t in (("ids", np.int64), ("groups", np.int64), ("cores", float), ("rows", float))]
        other, of, core = held[:3]
        vectors = held[3].reshape(len(other), -1)
        half = (vectors * vectors).sum(axis=1) / 2
        wanting = np.flatnonzero(~np.isnan(bounds))
        out = []
        for start in range(0, len(wanting), ROWS):
            now = wanting[start : start + ROWS]
            best = _Best(k, room, rows[now], ids[now], cores[now], bounds[now], vectors, other, core)
            mine = groups[now]
            apart = mine[:, None]
            for left in range(0, len(other), WIDE):
                part = slice(left, left + WIDE)
                # A distance is within a limit if the product less half the other's square is beyond what the limit asks.
                products = best.rows @ vectors[part].T
                products -= half[part]
                near = products >= best.asked()[:, None]
                if np.count_nonzero(near) > near.size // 64:
                    near &= of[part] != apart
                i, j = np.nonzero(near)
                fine = of[j + left] != mine[i]
                i, j = i[fine], j[fine]
                if len(i):
                    best.add(i, j + left, products[i, j])
            out.append(best.found())
        return out

    return lambda left, right: search(left, right) if len(left) and len(right) else pd.DataFrame({"id": [], "other": [], "weight": []})


def _fresh(rows: DataFrame) -> DataFrame:
    """rows with columns of its own, so that they can meet others from the same table."""
    return rows.select(*[F.col(c).alias(c) for c in rows.columns])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k edges of least weight of each point: (id, other, weight, rank), ties by the smaller, then the larger id."""
    edge = F.struct("weight", F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi"), "other")
    one = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(edge)), 1, k).alias("edges"))
    return one.select("id", F.posexplode("edges").alias("rank", "e")).select("id", "e.other", "e.weight", "rank")


def nearest(blocks: Blocks, known: DataFrame, k: int) -> DataFrame:
    """(id, other, weight, rank): the k edges of least weight, exactly, of each point of known(id, group, core, bound) that has a bound.

    The weight of an edge is the greatest of the distance and both cores. Edges above a point's
    bound, and those within a group, are not searched. Ties go to the smaller pair of ids.
    """
    if not blocks.n:
        return blocks.spark.createDataFrame([], "id long, other long, weight double, rank int")
    packed = blocks.pack(known)
    asking = packed.filter("wanting").select("block", "ids", "rows", "groups", "cores", "bounds")
    own = asking.groupBy("block").cogroup(_fresh(packed.select("block", "ids", "rows", "groups", "cores")).groupBy("block")).applyInPandas(_search(k, blocks.room), FOUND)
    own = stored(_best(own, k))
    # What a point still seeks is nearer than the k-th that its own block has.
    reached = own.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.max("weight").alias("w")).filter(F.col("c") == k).select("id", "w")
    seeking = known.join(reached, "id", "left").withColumn("bound", F.least("bound", "w")).drop("w")
    packed = blocks.pack(seeking)
    # Narrow rows, one a block and pivot, meet the blocks of that pivot.
    sides = packed.filter("wanting").select("block", "bound", F.posexplode(F.arrays_zip("near", "far")).alias("pivot", "x")).select("block", "bound", "pivot", "x.near", "x.far")
    least = F.greatest(F.col("near") - F.col("hi"), F.col("lo") - F.col("far"), F.lit(0.0))
    pairs = sides.join(blocks.spans, "pivot").filter((F.col("block") != F.col("other")) & (least <= F.col("bound") + blocks.room))
    # The blocks of a pivot, or of some pivots, search together.
    bundle = F.floor(F.col("pivot") * BUNDLES / len(blocks.pivots)).cast("int")
    home = _fresh(packed.select("block", bundle.alias("bundle")))
    pairs = pairs.select("block", "other").join(home, "block")
    met = stored(pairs.groupBy("bundle", "other").agg(F.collect_list("block").alias("lefts")))
    tally = met.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / MEET).alias("parts"))
    met = met.join(tally, "bundle").withColumn("part", F.pmod(F.xxhash64("other"), F.col("parts")))
    of = met.select("bundle", "part", F.explode("lefts").alias("block")).distinct()
    left = packed.select("block", "ids", "rows", "groups", "cores", "bounds").join(of, "block")
    right = packed.select(F.col("block").alias("other"), "ids", "rows", "groups", "cores").join(met.select("other", "bundle", "part", "lefts"), "other")
    far = left.groupBy("bundle", "part").cogroup(_fresh(right).groupBy("bundle", "part")).applyInPandas(_search(k, blocks.room), FOUND)
    return stored(_best(own.select("id", "other", "weight").unionByName(far), k))


@tidied
def knn(points: DataFrame, k: int, blocks: Blocks | None = None) -> DataFrame:
    """(id, other, weight, rank): the k nearest other points, exactly, by Euclidean distance rounded to nine places; ranks from 0, ties to the smaller pair of ids. points(id, vec) have distinct ids and vectors of one length."""
    blocks = blocks or Blocks(points)
    known = points.select("id", F.col("id").alias("group"), F.lit(0.0).alias("core"), F.lit(float("inf")).alias("bound"))
    return nearest(blocks, known, k)
