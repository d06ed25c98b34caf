"""A plane in which near points stay near: fuzzy neighbour graph, spectral start, sampled gradients.

Each point's exact neighbours get weights that fall with the distance beyond the nearest one,
at a rate that gives every point the same total; both directions are joined as fuzzy sets.
The start is the graph's two smoothest directions, by power iteration. Then, round by round,
edges sampled by their weights pull their ends together and random other points push them
apart. Coordinates are a table, a round is a few joins, and its sums are of whole numbers, so
the result is the same however the rows are laid out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.operators.cut import stored, tidied
from corvella.operators.neighbours import knn
from corvella.operators.places import in_order

# The curve 1 / (1 + a * d ** (2 * b)) that is 1 up to a distance of 0.1 and then falls by e over 1.
CURVE_A, CURVE_B = 1.5769434603113077, 0.8950608779109733

#: The greatest pull or push of one edge, and pushes for each pull.
CLIP, PUSHES = 4.0, 5

#: What share of a round's summed forces a point follows. All edges of a round act at once, not one after the other, and the whole sum would overshoot.
SHARE = 0.1

#: Sums are of whole multiples of this.
UNIT = 1e-9


def _whole(x: Column) -> Column:
    return F.round(x / UNIT).cast("long")


def _fuzzy(lists: DataFrame, total: float) -> DataFrame:
    """(lo, hi, w) of neighbour lists (id, others array<struct<other, distance>>): weights of both directions joined."""

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            width = max(map(len, b["distances"]), default=0)
            d = np.full((len(b), width), np.inf)
            for i, x in enumerate(b["distances"]):
                d[i, : len(x)] = x
            first = np.where(d > 0, d, np.inf).min(axis=1, initial=np.inf)
            over = np.maximum(0, d - np.where(np.isfinite(first), first, 0)[:, None])
            low, high, rate = np.zeros(len(b)), np.full(len(b), np.inf), np.ones(len(b))
            for _ in range(64):
                much = np.exp(-over / rate[:, None]).sum(axis=1) > total
                high, low = np.where(much, rate, high), np.where(much, low, rate)
                rate = np.where(np.isfinite(high), (low + high) / 2, rate * 2)
            w = np.exp(-over / np.maximum(rate, 1e-12)[:, None])
            yield pd.DataFrame({"id": b["id"], "others": b["others"], "w": [np.round(w[i, : len(x)], 9) for i, x in enumerate(b["others"])]})

    one = lists.mapInPandas(weigh, "id long, others array<long>, w array<double>").select("id", F.explode(F.arrays_zip("others", "w")).alias("e"))
    pairs = one.select(F.least("id", "e.others").alias("lo"), F.greatest("id", "e.others").alias("hi"), "e.w").groupBy("lo", "hi")
    both = F.when(F.col("c") == 2, F.col("most") + F.col("least") - F.col("most") * F.col("least")).otherwise(F.col("most"))
    return pairs.agg(F.count(F.lit(1)).alias("c"), F.max("w").alias("most"), F.min("w").alias("least")).select("lo", "hi", F.round(both, 9).alias("w"))


def graph(points: DataFrame, neighbours: int = 15) -> DataFrame:
    """(a, b, w), both ways, of points(id, vec) by cosine distance; each point is one of its own neighbours, as their number is counted."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    unit = points.select("id", F.transform("vec", lambda x: F.when(length > 0, x / length).otherwise(0.0)).alias("vec"))
    near = knn(unit, max(1, neighbours - 1))
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "weight"))).alias("l"))
    lists = lists.select("id", F.transform("l", lambda x: x["other"]).alias("others"), F.transform("l", lambda x: F.round(x["weight"] * x["weight"] / 2, 9)).alias("distances"))
    edges = stored(_fuzzy(lists, float(np.log2(neighbours))))
    return stored(edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "w").unionByName(edges.select(F.col("hi").alias("a"), F.col("lo").alias("b"), "w")))


def _start(edges: DataFrame, numbered: DataFrame, steps: int, seed: int) -> DataFrame:
    """(n, x, y): the two smoothest directions of the graph beside the constant one, to a width of 20."""
    degree = stored(numbered.join(edges.groupBy("a").agg(F.sum(_whole(F.col("w"))).alias("d")), numbered["n"] == F.col("a"), "left").select("n", F.sqrt(F.greatest(F.coalesce("d", F.lit(0)) * UNIT, F.lit(1e-6))).alias("root")))
    spread = lambda salt: F.pmod(F.xxhash64("n", F.lit(seed), F.lit(salt)), F.lit(1 << 20)) / float(1 << 20) - 0.5
    at = stored(degree.select("n", "root", spread(1).alias("x"), spread(2).alias("y")))
    dot = lambda p, q: F.sum(_whole(F.col(p) * F.col(q))) * UNIT
    for _ in range(steps):
        # Without the constant direction, and y without x, both of unit length: one row of products.
        m = at.agg(dot("root", "root").alias("rr"), dot("root", "x").alias("rx"), dot("root", "y").alias("ry"), dot("x", "x").alias("xx"), dot("x", "y").alias("xy"), dot("y", "y").alias("yy")).first()
        cx, cy = m["rx"] / m["rr"], m["ry"] / m["rr"]
        xx, xy = max(m["xx"] - cx * m["rx"], 1e-12), m["xy"] - cx * m["ry"]
        c = xy / xx
        yy = max(m["yy"] - cy * m["ry"] - c * xy, 1e-12)
        x = F.col("x") - F.lit(cx) * F.col("root")
        y = F.col("y") - F.lit(cy) * F.col("root") - F.lit(c) * x
        # Lengths that keep whole multiples of UNIT fine however many points there are.
        size = float(m["rr"]) ** 0.5
        at = at.select("n", "root", (x * (size / xx**0.5)).alias("x"), (y * (size / yy**0.5)).alias("y"))
        moved = edges.join(at.select(F.col("n").alias("b"), (F.col("x") / F.col("root")).alias("bx"), (F.col("y") / F.col("root")).alias("by")), "b")
        moved = moved.groupBy(F.col("a").alias("n")).agg((F.sum(_whole(F.col("w") * F.col("bx"))) * UNIT).alias("sx"), (F.sum(_whole(F.col("w") * F.col("by"))) * UNIT).alias("sy"))
        half = lambda v, s: ((F.col(v) + F.coalesce(s, F.lit(0.0)) / F.col("root")) / 2).alias(v)
        at = stored(at.join(moved, "n", "left").select("n", "root", half("x", "sx"), half("y", "sy")))
    wide = at.agg(F.max(F.abs(F.col("x") / F.col("root"))).alias("x"), F.max(F.abs(F.col("y") / F.col("root"))).alias("y")).first()
    scale = lambda v: (F.col(v) / F.col("root") * F.lit(10 / max(wide[v] or 0.0, 1e-12)) + 1e-4 * (F.pmod(F.xxhash64("n", F.lit(seed), F.lit(v)), F.lit(1 << 20)) / float(1 << 20))).alias(v)
    return at.select("n", scale("x"), scale("y"))


@tidied
def plane(points: DataFrame, neighbours: int = 15, rounds: int = 30, start_steps: int = 12, seed: int = 42) -> DataFrame:
    """(id, x, y) of points(id, vec array<double>): distinct ids, vectors of one length. An empty table gives an empty result, a lone point the origin."""
    # Numbers without gaps, for drawing points to push away.
    numbered = in_order(points.select("id", "vec", F.lit(0).alias("one")), ["one"], [F.xxhash64("id", F.lit(seed)), "id"]).select(F.col("rank").alias("n"), "id", "vec")
    n = numbered.count()
    if n < 2:
        return points.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    edges = graph(numbered.select(F.col("n").alias("id"), "vec"), min(neighbours, n))
    most = edges.agg(F.max("w")).first()[0]
    at = stored(_start(edges, numbered.select("n"), start_steps, seed))
    clip = lambda g: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), g))
    for t in range(rounds):
        rate = 1.0 - t / rounds
        drawn = F.pmod(F.xxhash64(F.least("a", "b"), F.greatest("a", "b"), F.lit(t), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
        one = at.select(F.col("n").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        other = at.select(F.col("n").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
        pulled = edges.filter(drawn < F.col("w") / most).select("a", "b").join(one, "a")
        draw = F.pmod(F.xxhash64("a", "b", F.lit(t), F.lit(seed), F.col("s")), F.lit(n))
        pushed = pulled.select("a", "b", "ax", "ay", F.explode(F.sequence(F.lit(1), F.lit(PUSHES))).alias("s")).select("a", draw.alias("b"), "ax", "ay").filter("a <> b")
        pairs = pulled.select("a", "b", "ax", "ay", F.lit(True).alias("pull")).unionByName(pushed.select("a", "b", "ax", "ay", F.lit(False).alias("pull"))).join(other, "b")
        dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
        d2 = dx * dx + dy * dy
        power = F.pow(d2, F.lit(CURVE_B))
        pull = F.when(d2 > 0, -2 * CURVE_A * CURVE_B * power / d2 / (1 + CURVE_A * power)).otherwise(0.0)
        push = 2 * CURVE_B / ((0.001 + d2) * (1 + CURVE_A * power))
        force = F.when(F.col("pull"), pull).otherwise(push)
        moved = pairs.select("a", _whole(clip(force * dx)).alias("gx"), _whole(clip(force * dy)).alias("gy")).groupBy(F.col("a").alias("n")).agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))
        step = lambda v, g: (F.col(v) + F.lit(rate) * clip(F.coalesce(g, F.lit(0)) * (UNIT * SHARE))).alias(v)
        at = stored(at.join(moved, "n", "left").select("n", step("x", "gx"), step("y", "gy")))
    return at.join(numbered.select("n", "id"), "n").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
