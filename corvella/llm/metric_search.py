"""Exact top-k search by inner product over an M-tree (operator 10).

The tree has four levels. The root holds pivots; each pivot's vectors are cut into chunks
that one task can hold, and a chunk is bulk-loaded by distance into pages; a page is stored
as one row with its leaves. Every node has a routing object, a covering radius, and its
routing object's distance to that of its parent; every entry has its distance to its leaf's.

A query first searches the page that its own vector lies in, which gives it a score to beat.
It then goes down from the root: a node is left out, often without computing its distance,
where the triangle inequality says that nothing below it can reach that score. Within a page
leaves are visited best first until the next one cannot reach the k-th score. Only queries
travel, and a page goes to its queries once for each block of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvella.llm.store import Cuts, shuffle_width

#: Vectors that are bulk-loaded together, vectors of one page, entries of one leaf, queries that meet a node at once.
CHUNK, PAGE, LEAF, BLOCK = 32_768, 2048, 64, 1024

#: Pivots are the vectors of the smallest id hashes: one for each PER_PIVOT vectors, MOST_PIVOTS at most. Further levels grow with the table.
PER_PIVOT, MOST_PIVOTS = 4096, 512

#: Products of whole numbers up to this size are exact in doubles.
EXACT = float(1 << 52)

SLACK = 1e-9


def whole_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, vec array<long>): floor(scale * x) of each component; vectors null or with null or non-finite components, or without id, are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return table.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine).select("vec_id", F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("vec"))


def _matrix(vectors, dim: int) -> np.ndarray:
    """Rows of doubles, short vectors filled with zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; doubles give them exactly unless components are huge."""
    if not rows.size or np.abs(rows).max() * np.abs(q).max() * rows.shape[1] < EXACT:
        return (rows @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in rows], dtype=object)


def _loose(bound: np.ndarray) -> np.ndarray:
    """A bound with room for rounding."""
    return bound + SLACK * (np.abs(bound) + 1)


def unmeasured(q2: float, most2: np.ndarray, parent: np.ndarray | float, away: np.ndarray, radius: np.ndarray | float) -> np.ndarray:
    """The greatest product below nodes whose own distance to the query is not computed.

    parent: the query's distance to the parent's routing object. away: the stored distances
    of the nodes' routing objects to it. Entries are nodes without a radius.
    """
    return _loose((q2 + most2 - np.maximum(0, np.abs(parent - away) - radius) ** 2) / 2)


def measured(q2: float, most2: np.ndarray, product: np.ndarray, away: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The greatest product below nodes at distance `away` whose routing objects have these products with the query."""
    return _loose(np.minimum(product + np.sqrt(q2) * radius, (q2 + most2 - np.maximum(0, away - radius) ** 2) / 2))


def cut_by_distance(rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of rows in parts of at most `most`: a part is halved by how much nearer its rows are to one of two far ones."""
    todo, done = [np.arange(len(rows))], []
    while todo:
        at = todo.pop()
        if len(at) <= most:
            done.append(at)
            continue
        part = rows[at]
        one = part[((part - part[0]) ** 2).sum(axis=1).argmax()]
        other = part[((part - one) ** 2).sum(axis=1).argmax()]
        order = np.argsort(part @ (other - one), kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return done


def _router(rows: np.ndarray) -> int:
    """The place of the row nearest to the mean."""
    return int(((rows - rows.mean(axis=0)) ** 2).sum(axis=1).argmin())


@dataclass
class Page:
    """Leaves of entries. computed counts the distances and products that searches have computed."""

    ids: np.ndarray
    rows: np.ndarray
    start: np.ndarray
    router: np.ndarray
    radius: np.ndarray
    away: np.ndarray
    parent: np.ndarray
    computed: int = 0
    norm2: np.ndarray = field(init=False)
    most2: np.ndarray = field(init=False)

    def __post_init__(self):
        self.norm2 = (self.rows * self.rows).sum(axis=1)
        self.most2 = np.maximum.reduceat(self.norm2, self.start[:-1])

    @classmethod
    def load(cls, ids: np.ndarray, rows: np.ndarray, own: np.ndarray) -> Page:
        """own: the page's routing object."""
        leaves = cut_by_distance(rows, LEAF)
        by = np.concatenate(leaves)
        ids, rows = ids[by], rows[by]
        start = np.r_[0, np.cumsum([len(x) for x in leaves])]
        router = np.array([a + _router(rows[a:b]) for a, b in zip(start, start[1:], strict=False)])
        parent = np.linalg.norm(rows - np.repeat(rows[router], np.diff(start), axis=0), axis=1)
        return cls(ids, rows, start, router, np.maximum.reduceat(parent, start[:-1]), np.linalg.norm(rows[router] - own, axis=1), parent)

    def stored(self) -> dict[str, bytes]:
        return {k: getattr(self, k).astype(t).tobytes() for k, t in LAYOUT.items()}

    @classmethod
    def of(cls, row, dim: int) -> Page:
        made = {k: np.frombuffer(row[k], dtype=t) for k, t in LAYOUT.items()}
        return cls(**made | {"rows": made["rows"].reshape(-1, dim)})

    def search(self, query_id: int, q: np.ndarray, k: int, floor: float, to_page: float) -> list[tuple[int, int]]:
        """The k best (score, id) of at least `floor`, without the query's own id; to_page: the query's distance to the page's routing object."""
        q2 = float(q @ q)
        able = np.flatnonzero(unmeasured(q2, self.most2, to_page, self.away, self.radius) >= floor)
        if not len(able):
            return []
        product = self.rows[self.router[able]] @ q
        to = np.sqrt(np.maximum(0, q2 + self.norm2[self.router[able]] - 2 * product))
        self.computed += len(able)
        bound = measured(q2, self.most2[able], product, to, self.radius[able])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] >= floor]
        score, ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at, step = 0, 1
        # Best first, some leaves at once: the more have been seen, the less the next ones change the k-th score.
        while at < len(order) and bound[order[at]] >= floor:
            now = order[at : at + step]
            at, step = at + step, step * 2
            first, last = self.start[able[now]], self.start[able[now] + 1]
            size = last - first
            place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            place = place[unmeasured(q2, self.norm2[place], np.repeat(to[now], size), self.parent[place], 0.0) >= floor]
            found = _exact(self.rows[place], q)
            self.computed += len(place)
            keep = (found >= floor) & (self.ids[place] != query_id)
            if keep.any():
                score, ids = np.r_[score, found[keep]], np.r_[ids, self.ids[place[keep]]]
                best = np.lexsort((ids, -score))[:k]
                score, ids = score[best], ids[best]
                if len(ids) == k:
                    floor = max(floor, float(score[-1]))
        return list(zip(score.tolist(), ids.tolist(), strict=True))


#: How a page's arrays are stored.
LAYOUT = {"ids": np.int64, "rows": np.float64, "start": np.int64, "router": np.int64, "radius": np.float64, "away": np.float64, "parent": np.float64}

HOME = "array<struct<query_id:long,q:binary,least:double,found:array<struct<vec_id:long,score:long>>,computed:long>>"
TREE = f"page string, pivot long, centre binary, spread double, to_pivot double, top2 double, home {HOME}, " + ", ".join(f"{c} binary" for c in LAYOUT)
FOUND = "query_id long, vec_id long, score long, computed long"


def _at_home(page: Page, centre: np.ndarray, k: int, every: int) -> list[dict]:
    """The page's own queries, with what they find in it and the score that they have to beat elsewhere."""
    out = []
    for at in np.flatnonzero(page.ids % every == 0):
        q, before = page.rows[at], page.computed
        found = page.search(int(page.ids[at]), q, k, -np.inf, float(np.linalg.norm(q - centre)))
        least = float(found[-1][0]) if len(found) == k else -np.inf
        out.append({"query_id": int(page.ids[at]), "q": q.tobytes(), "least": least, "found": [{"vec_id": i, "score": s} for s, i in found], "computed": page.computed - before})
    return out


def _grown(dim: int, pivots: np.ndarray, k: int, every: int):
    """Pages of chunks of (vec_id, vec, pivot, part), sorted by pivot and part."""

    def chunk(rows: pd.DataFrame) -> pd.DataFrame:
        pivot, part = int(rows["pivot"].iloc[0]), int(rows["part"].iloc[0])
        ids, vectors = rows["vec_id"].to_numpy(), _matrix(rows["vec"], dim)
        out = []
        for i, at in enumerate(cut_by_distance(vectors, PAGE)):
            centre = vectors[at[_router(vectors[at])]]
            page = Page.load(ids[at], vectors[at], centre)
            spread, to_pivot = float(np.linalg.norm(vectors[at] - centre, axis=1).max()), float(np.linalg.norm(centre - pivots[pivot]))
            out.append({"page": f"{pivot}-{part}-{i}", "pivot": pivot, "centre": centre.tobytes(), "spread": spread, "to_pivot": to_pivot, "top2": float(page.norm2.max()), "home": _at_home(page, centre, k, every)} | page.stored())
        return pd.DataFrame(out)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            key = list(zip(b["pivot"], b["part"], strict=True))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j and held and (held[0]["pivot"].iloc[0], held[0]["part"].iloc[0]) != key[i]:
                    yield chunk(pd.concat(held))
                    held = []
                if i < j:
                    held.append(b.iloc[i:j])
        if held:
            yield chunk(pd.concat(held))

    return each


def _descend(nodes: pd.DataFrame, asked: pd.DataFrame, pivot: np.ndarray) -> pd.DataFrame:
    """(query_id, q, page, least, to_page): the pages of one pivot that may hold a better score than a query has."""
    centre = np.frombuffer(b"".join(nodes["centre"])).reshape(len(nodes), -1)
    centre2 = (centre * centre).sum(axis=1)
    spread, to_pivot, top2 = (nodes[c].to_numpy() for c in ("spread", "to_pivot", "top2"))
    name = nodes["page"].to_numpy()
    out = []
    for i, raw, home, least in zip(asked["query_id"], asked["q"], asked["home"], asked["least"], strict=True):
        q = np.frombuffer(raw)
        q2 = float(q @ q)
        able = np.flatnonzero((unmeasured(q2, top2, float(np.linalg.norm(q - pivot)), to_pivot, spread) >= least) & (name != home))
        product = centre[able] @ q
        to = np.sqrt(np.maximum(0, q2 + centre2[able] - 2 * product))
        for x in np.flatnonzero(measured(q2, top2[able], product, to, spread[able]) >= least):
            out.append((i, raw, name[able[x]], least, float(to[x])))
    return pd.DataFrame(out, columns=["query_id", "q", "page", "least", "to_page"])


def _block(n: Column) -> Column:
    """Which of the blocks of n queries a query is in."""
    return F.pmod(F.xxhash64("query_id", F.lit(5)), F.greatest(F.lit(1), F.ceil(n / BLOCK))).cast("int")


def _meet(asked: DataFrame, nodes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a block: queries of one key in blocks, and its nodes once for each block that has queries."""
    tally = asked.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    dealt = asked.join(tally, key).withColumn("block", _block(F.col("n"))).drop("n")
    blocks = dealt.select(F.col(key).alias("of"), F.col("block").alias("at")).distinct()
    return dealt, nodes.join(blocks, F.col(key) == F.col("of")).drop("of").withColumnRenamed("at", "block")


def top_k(table: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other vectors for each vec_id divisible by `every`.

    Ties go to the smaller vec_id; with fewer than k others all come back, and a lone vector
    gets no rows. Of rows that repeat a vec_id the first by its components counts. Vectors that
    are null, hold null or non-finite components or have a null id take no part; other columns
    of the table are not read. A chunk holds about CHUNK vectors however many share a pivot or
    are equal. An empty table gives an empty result.
    """
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = nearest(table, k, every)
    if found is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(table: DataFrame, k: int = 10, every: int = 100) -> DataFrame | None:
    """(query_id, vec_id, score, computed): the best of each searched page, of which the best k are the result; None without vectors.

    computed: distances and products computed within the page, on its first row.
    """
    spark = table.sparkSession
    cuts = Cuts(spark, "search")
    vectors = cuts.cut(whole_vectors(table).groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not size["n"] or not size["dim"]:
        return None
    n, dim = size["n"], size["dim"]
    # At most MOST_PIVOTS vectors come to the driver.
    count = max(1, min(MOST_PIVOTS, n // PER_PIVOT))
    pivots = _matrix([r["vec"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()], dim)
    pivots2 = (pivots * pivots).sum(axis=1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = _matrix(b["vec"], dim)
            at = (pivots2[None, :] - 2 * (rows @ pivots.T)).argmin(axis=1)
            yield pd.DataFrame({"vec_id": b["vec_id"], "vec": b["vec"], "pivot": at, "away": np.linalg.norm(rows - pivots[at], axis=1), "norm2": (rows * rows).sum(axis=1)})

    placed = cuts.cut(vectors.mapInPandas(place, "vec_id long, vec array<long>, pivot long, away double, norm2 double"), "placed")
    # One row a pivot.
    root = placed.groupBy("pivot").agg(F.max("away").alias("radius"), F.max("norm2").alias("most2"), F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    known = root.orderBy("pivot").collect()
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("parts")).cast("int")
    dealt = placed.join(F.broadcast(root.select("pivot", "parts")), "pivot").withColumn("part", part).select("vec_id", "vec", "pivot", "part")
    chunks = sum(r["parts"] for r in known)
    dealt = dealt.repartition(max(1, min(chunks, shuffle_width(spark))), "pivot", "part").sortWithinPartitions("pivot", "part", "vec_id")
    tree = cuts.cut(dealt.mapInPandas(_grown(dim, pivots, k, every), TREE), "tree")
    cuts.drop(vectors, placed)
    home = tree.select(F.col("page").alias("home"), F.inline("home"))
    number = np.array([r["pivot"] for r in known])
    radius, most2 = (np.array([r[c] for r in known], dtype=float) for c in ("radius", "most2"))

    def from_root(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, centre2 = pivots[number], pivots2[number]
        for b in batches:
            out = []
            for row in zip(b["query_id"], b["q"], b["home"], b["least"], strict=True):
                q = np.frombuffer(row[1])
                q2, product = float(q @ q), centre @ q
                to = np.sqrt(np.maximum(0, q2 + centre2 - 2 * product))
                out += [(*row, p) for p in number[measured(q2, most2, product, to, radius) >= row[3]]]
            yield pd.DataFrame(out, columns=["query_id", "q", "home", "least", "pivot"])

    def in_pivot(asked: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(nodes):
            return pd.DataFrame({"query_id": [], "q": [], "page": [], "least": [], "to_page": []})
        return _descend(nodes, asked, pivots[int(nodes["pivot"].iloc[0])])

    def in_page(asked: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asked) and len(pages):
            page = Page.of(pages.iloc[0], dim)
            for i, raw, least, to in zip(asked["query_id"].tolist(), asked["q"], asked["least"].tolist(), asked["to_page"].tolist(), strict=True):
                before = page.computed
                found = page.search(i, np.frombuffer(raw), k, least, to)
                rows += [(i, x, s, page.computed - before if not at else 0) for at, (s, x) in enumerate(found)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "computed"], dtype=np.int64)

    asked = home.select("query_id", "q", "home", "least").mapInPandas(from_root, "query_id long, q binary, home string, least double, pivot long")
    left, right = _meet(cuts.cut(asked, "asked"), tree.select("pivot", "page", "centre", "spread", "to_pivot", "top2"), "pivot")
    routed = left.groupBy("pivot", "block").cogroup(right.groupBy("pivot", "block")).applyInPandas(in_pivot, "query_id long, q binary, page string, least double, to_page double")
    left, right = _meet(cuts.cut(routed, "routed"), tree.select("page", *LAYOUT), "page")
    far = left.groupBy("page", "block").cogroup(right.groupBy("page", "block")).applyInPandas(in_page, FOUND)
    own = home.select("query_id", F.posexplode("found").alias("at", "x"), "computed").select("query_id", "x.vec_id", "x.score", F.when(F.col("at") == 0, F.col("computed")).otherwise(0).alias("computed"))
    return cuts.cut(own.unionByName(far), "found")
