"""Hard-negative mining by norm-bucketed search (operator 13).

Candidates are sorted by norm, longest first, and cut into pages; some pages are a tile. By
Cauchy and Schwarz no product in a page exceeds the anchor's length times the page's
greatest, so a tile is left out where that stays below what every anchor of a block still
needs, and a page, within a tile, where it does for an anchor. What an anchor needs is the
lower limit of its window, or the k-th score found so far if that is higher. Tiles are
searched in waves that double, so k-th scores found in one wave prune the next, and the rows
that all waves emit grow with the logarithm of the table.

Anchors and tiles meet as blocks of matrices: a block of anchors and a tile are one task's
work, and its products are one matrix product a page.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvella.llm.metric_search import EXACT, _loose, _matrix
from corvella.llm.places import in_order
from corvella.llm.store import Cuts

#: Candidates of a page, pages of a tile, anchors of a block.
PAGE, TILE, BLOCK = 2048, 8, 8192

#: Anchors whose products with a page are held at once.
AT_ONCE = 256

#: No limit, below or above.
LEAST, MOST = -(1 << 62), 1 << 62

PAGES = "key int, page long, tile long, top double, ids binary, labels binary, rows binary"
FOUND = "anchor_id long, pane int, vec_id long, score long"


def labelled_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vec array<long>, norm): floor(scale * x) of each component.

    Where vec_id is divisible by 7, label is (label + 1) % 10. Rows without id or label, and
    vectors null or with null or non-finite components, are left out.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = table.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    rows = rows.select("vec_id", label.alias("label"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("vec"))
    # Of rows that repeat a vec_id the first counts.
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("vec", "label")).alias("x")).select("vec_id", "x.label", "x.vec")
    return rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))


def _pages(vectors: DataFrame, key: Column, cuts: Cuts, dim: int, page: int, tile: int) -> DataFrame:
    """The vectors of each key in pages by norm, longest first."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        at = int(rows["page"].iloc[0])
        held = {"ids": rows["vec_id"].to_numpy(np.int64), "labels": rows["label"].to_numpy(np.int64), "rows": _matrix(rows["vec"], dim)}
        return pd.DataFrame({"key": [int(rows["key"].iloc[0])], "page": at, "tile": at // tile, "top": float(rows["norm"].max()), **{k: v.tobytes() for k, v in held.items()}})

    ordered = in_order(vectors.withColumn("key", key.cast("int")), cuts, ["key"], [F.desc("norm"), "vec_id"])
    return cuts.cut(ordered.withColumn("page", F.expr(f"rank div {page}")).drop("n").groupBy("key", "page").applyInPandas(packed, PAGES), "pages")


def _products(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """All inner products as whole numbers; doubles give them exactly unless components are huge."""
    if not rows.size or not others.size or np.abs(rows).max() * np.abs(others).max() * rows.shape[1] < EXACT:
        return (rows @ others.T).astype(np.int64)
    return np.array([[sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for q in others] for r in rows], dtype=object)


def _tile_search(dim: int, k: int, other: bool):
    """The k best of a tile for each pane of each anchor, from what the anchor still needs to the pane's upper limit; other: of other labels, else of the same."""

    def search(asked: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if not len(asked) or not len(pages):
            return pd.DataFrame(out, columns=["anchor_id", "pane", "vec_id", "score"])
        ids, labels = asked["vec_id"].to_numpy(np.int64), asked["label"].to_numpy(np.int64)
        rows, norm = _matrix(asked["vec"], dim), asked["norm"].to_numpy()
        need, high = [x.astype(np.int64) for x in asked["need"]], [x.astype(np.int64) for x in asked["high"]]
        least, most = np.array([x.min() for x in need]), np.array([x.max() for x in high])
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for page in pages.sort_values("page").itertuples():
            able = np.flatnonzero(_loose(norm * page.top) >= least)
            if not len(able):
                break  # later pages are no longer
            own, of = np.frombuffer(page.ids, np.int64), np.frombuffer(page.labels, np.int64)
            held = np.frombuffer(page.rows).reshape(len(own), dim)
            for start in range(0, len(able), AT_ONCE):
                now = able[start : start + AT_ONCE]
                score = _products(rows[now], held)
                fits = (score >= least[now, None]) & (score <= most[now, None]) & (own != ids[now, None]) & ((of != labels[now, None]) if other else (of == labels[now, None]))
                for j in np.flatnonzero(fits.any(axis=1)):
                    a = now[j]
                    at = np.flatnonzero(fits[j])
                    for w in range(len(need[a])):
                        place = at[(score[j, at] >= need[a][w]) & (score[j, at] <= high[a][w])]
                        if not len(place):
                            continue
                        s, i = score[j, place], own[place]
                        if (a, w) in best:
                            s, i = np.r_[best[a, w][0], s], np.r_[best[a, w][1], i]
                        first = np.lexsort((i, -s))[:k]
                        best[a, w] = s[first], i[first]
                        if len(first) == k:
                            need[a][w] = max(need[a][w], s[first[-1]])
                    least[a] = need[a].min()
        for (a, w), (s, i) in best.items():
            out += [(int(ids[a]), w, int(x), int(y)) for x, y in zip(i, s, strict=True)]
        return pd.DataFrame(out, columns=["anchor_id", "pane", "vec_id", "score"])

    return search


def _search(asked: DataFrame, pages: DataFrame, cuts: Cuts, dim: int, k: int, other: bool) -> DataFrame:
    """(anchor_id, pane, vec_id, score, rank): the k best candidates for each pane of asked (vec_id, label, vec, norm, key, block, low, high).

    low and high are the limits of an anchor's panes. Tiles of an anchor's key are searched.
    """
    tiles = cuts.cut(pages.groupBy("key", "tile").agg(F.max("top").alias("top")), "tiles")
    last = tiles.agg(F.max("tile")).first()[0]
    by = W.partitionBy("anchor_id", "pane").orderBy(F.desc("score"), "vec_id")
    best, first, width = None, 0, 1
    while last is not None and first <= last:
        need = F.col("low")
        wanting = asked
        if best is not None:
            kth = best.filter(F.col("rank") == k).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("pane", "score"))).alias("kth"))
            wanting = asked.join(kth, "vec_id", "left")
            need = F.transform("low", lambda v, i: F.greatest(v, F.coalesce(F.try_element_at("kth", i), v)))
        wanting = wanting.withColumn("need", need)
        blocks = wanting.groupBy("key", "block").agg(F.max("norm").alias("norm"), F.min(F.array_min("need")).alias("need"))
        # Narrow pairs: a row for each block and tile of the wave, before whole rows move.
        pairs = blocks.withColumn("tile", F.explode(F.sequence(F.lit(first), F.lit(min(last, first + width - 1))).cast("array<bigint>")))
        bound = F.col("norm") * F.col("top")
        pairs = cuts.cut(pairs.join(tiles, ["key", "tile"]).filter(bound + (bound + 1) * 1e-9 >= F.col("need")).select("key", "block", "tile"), f"pairs-{first}")
        left = wanting.join(pairs, ["key", "block"]).select("vec_id", "label", "vec", "norm", "need", "high", "key", "block", "tile")
        right = pages.join(pairs, ["key", "tile"])
        found = left.groupBy("key", "block", "tile").cogroup(right.groupBy("key", "block", "tile")).applyInPandas(_tile_search(dim, k, other), FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        before, best = best, cuts.cut(found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k), f"best-{first}")
        if before is not None:
            cuts.drop(before)
        first, width = first + width, width * 2
    return best


def hard_negatives(table: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, every: int = 100, page: int = PAGE, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor, a row whose vec_id is divisible by `every`.

    An anchor's positives are its best other rows of the same label; the negatives of a
    positive are the best rows of other labels whose score is from low to high hundredths of
    the positive's. Ties go to the smaller vec_id; where fewer exist all come back, and a
    positive of a score below zero has no window. Rows without id or label and vectors null or
    with null or non-finite components take no part; of rows that repeat a vec_id the first by
    components, then label, counts; short vectors are as if filled with zeros. Equal vectors
    are cut into pages like any others. An empty table gives an empty result; other columns
    are not read.

    The positives are searched in pages of one label each, the negatives in pages of all.
    """
    spark = table.sparkSession
    cuts = Cuts(spark, "negatives")
    none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    vectors = cuts.cut(labelled_vectors(table), "vectors")
    dim = vectors.agg(F.max(F.size("vec"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], none)
    anchors = vectors.filter(F.col("vec_id") % every == 0)

    def blocked(rows: DataFrame, key: Column) -> DataFrame:
        placed = in_order(rows.withColumn("key", key.cast("int")), cuts, ["key"], [F.desc("norm"), "vec_id"])
        return placed.withColumn("block", F.expr(f"rank div {block}")).drop("rank", "n")

    one = F.col("label")
    asked = blocked(anchors, one).withColumn("low", F.array(F.lit(LEAST))).withColumn("high", F.array(F.lit(MOST)))
    near = _search(asked, _pages(vectors, one, cuts, dim, page, tile), cuts, dim, positives, other=False).drop("pane")
    # Whole numbers throughout: 100 * score >= low * positive is score >= their quotient rounded up.
    panes = near.filter("score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "score", F.col("vec_id").alias("positive_id")))).alias("p"))
    limit = lambda hundredths, up: F.transform("p", lambda x: F.floor((x["score"] * hundredths + up).cast("decimal(38,0)") / 100).cast("long"))
    every_one = F.lit(0)
    asked = blocked(cuts.cut(anchors.join(panes, "vec_id").withColumn("low", limit(low, 99)).withColumn("high", limit(high, 0)), "windows"), every_one)
    far = _search(asked.drop("p"), _pages(vectors, every_one, cuts, dim, page, tile), cuts, dim, negatives, other=True)
    if far is None:
        return spark.createDataFrame([], none)
    named = asked.select(F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("pane", "x"))
    out = far.join(named, ["anchor_id", "pane"])
    return out.select("anchor_id", "x.positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("x.score").alias("positive_score"), F.col("score").alias("negative_score"))
