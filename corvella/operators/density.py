"""Density clustering: a hierarchy of clusters of any shape, and outliers that belong to none.

The distance at which two points reach each other is the greatest of their distance and of
each one's distance to its own nearest neighbours. The minimum spanning tree of these
distances is grown by Boruvka rounds, each a few joins: the exact neighbour lists give the
lightest edge of a component, and where they are too short to be sure of it an exact search
does. The rounds also give the dendrogram: each edge hangs in the chain below the lightest
edge that leaves its component, at the first round where that one is heavier. Subtree sizes
are sums along chains, round by round. Nodes with fewer than the least number of points are
dust; the others form a tree of clusters, of which the most stable ones are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.operators.cut import stored, tidied
from corvella.operators.neighbours import Blocks, knn, nearest
from corvella.operators.places import in_order, roots, summed

#: Weights below this count as this, so that equal points have a density.
LEAST_WEIGHT = 1e-9

#: An edge: its weight and its ends; edges are compared in this order, so no two are equal.
EDGE = ["w", "lo", "hi"]


def _edge(*names: str) -> Column:
    return F.struct(*[F.col(c) for c in (names or EDGE)])


class SpanningTree:
    """Boruvka's rounds over points(id, vec). rounds: (comp, w, lo, hi, into) of each, the lightest edge that leaves a component and the component it becomes part of."""

    def __init__(self, points: DataFrame, min_samples: int = 1, k: int = 15):
        k = max(k, min_samples)
        blocks = Blocks(points)
        lists = knn(points, k, blocks)
        reach = lists.groupBy("id").agg(F.max(F.when(F.col("rank") == min_samples - 1, F.col("weight"))).alias("core"), F.count(F.lit(1)).alias("c"), F.max("weight").alias("far"))
        # Points that have fewer neighbours than asked for know all points. Beyond its list a point has no edge below the horizon.
        horizon = F.when(F.col("c") < k, F.lit(float("inf"))).otherwise(F.greatest("core", "far"))
        self.cores = stored(points.select("id").join(reach, "id", "left").select("id", F.coalesce("core", F.lit(0.0)).alias("core"), F.coalesce(horizon, F.lit(float("inf"))).alias("horizon")))
        a, b = self.cores.select("id", F.col("core").alias("ca")), self.cores.select(F.col("id").alias("other"), F.col("core").alias("cb"))
        edges = lists.join(a, "id").join(b, "other").select(F.greatest("weight", "ca", "cb").alias("w"), F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi")).distinct()
        edges = stored(edges)
        comps = stored(points.select("id", F.col("id").alias("comp")))
        self.rounds: list[DataFrame] = []
        while True:
            crossing = self._crossing(edges, comps)
            light = stored(self._lightest(crossing))
            best = stored(comps.join(light.select("comp", F.col("w").alias("best")), "comp", "left").join(self.cores, "id"))
            # An edge that is in neither end's list is beyond both horizons, so the least one outside of a component counts too.
            low = best.groupBy("comp").agg(F.min("horizon").alias("low")).orderBy("low", "comp").limit(2).collect()
            if len(low) > 1:
                outside = F.when(F.col("comp") == low[0]["comp"], low[1]["low"]).otherwise(low[0]["low"])
                most = F.coalesce("best", F.lit(float("inf")))
                unsure = F.greatest("horizon", outside) <= most
                if best.filter(unsure).limit(1).count():
                    # Also where no list leaves the component.
                    found = nearest(blocks, best.select("id", F.col("comp").alias("group"), "core", F.when(unsure, most).alias("bound")), 1)
                    more = found.select(F.col("weight").alias("w"), F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi"))
                    edges = stored(edges.unionByName(more).distinct())
                    light = stored(self._lightest(self._crossing(edges, comps)))
            # Two components that chose the same edge hold on to the smaller; all others to the one chosen.
            chosen = light.select("comp", *EDGE, "to")
            back = chosen.select(F.col("comp").alias("to"), F.col("to").alias("comp"), F.lit(True).alias("mutual"))
            links = chosen.join(back, ["comp", "to"], "left").select(F.col("comp").alias("node"), F.when(F.col("mutual") & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("to"))
            if not links.limit(1).count():
                break
            into = roots(links)
            self.rounds.append(stored(chosen.join(into.select(F.col("node").alias("comp"), F.col("root").alias("into")), "comp").select("comp", *EDGE, "into")))
            comps = stored(comps.join(self.rounds[-1].select("comp", "into"), "comp").select("id", F.col("into").alias("comp")))
            edges = stored(self._crossing(edges, comps).select(*EDGE).distinct())

    @staticmethod
    def _crossing(edges: DataFrame, comps: DataFrame) -> DataFrame:
        a, b = comps.select(F.col("id").alias("lo"), F.col("comp").alias("ca")), comps.select(F.col("id").alias("hi"), F.col("comp").alias("cb"))
        return edges.join(a, "lo").join(b, "hi").filter("ca <> cb")

    @staticmethod
    def _lightest(crossing: DataFrame) -> DataFrame:
        """(comp, w, lo, hi, to): the lightest edge of each component."""
        both = crossing.select(*EDGE, F.explode(F.array(F.struct(F.col("ca").alias("comp"), F.col("cb").alias("to")), F.struct(F.col("cb").alias("comp"), F.col("ca").alias("to")))).alias("x"))
        return both.groupBy("x.comp").agg(F.min(F.struct(*EDGE, "x.to")).alias("e")).select("comp", "e.*")

    def edges(self) -> DataFrame:
        """w, lo, hi of the tree."""
        out = self.rounds[0].select(*EDGE)
        for r in self.rounds[1:]:
            out = out.unionByName(r.select(*EDGE))
        return out.distinct()


def dendrogram(tree: SpanningTree) -> tuple[DataFrame, DataFrame]:
    """Nodes (w, lo, hi, up: the edge above or null, size: points below), one an edge; points (id, up)."""
    hung, chains, walking = [], [], None
    for level, light in enumerate(tree.rounds):
        hung.append(light.select(F.lit(level).alias("level"), F.col("comp").alias("chain"), _edge().alias("on")))
        if walking is not None:
            # Edges that are lighter than the one that leaves their component hang below it; the others go on.
            met = stored(walking.join(light.select("comp", _edge().alias("above"), "into"), "comp"))
            chains.append(met.filter(_edge() < F.col("above")).select(*EDGE, F.lit(level).alias("level"), F.col("comp").alias("chain")))
            walking = met.filter(_edge() > F.col("above")).select(*EDGE, F.col("into").alias("comp"))
        fresh = light.select(*EDGE, F.col("into").alias("comp")).distinct()
        walking = stored(fresh if walking is None else walking.unionByName(fresh))
    top = len(tree.rounds)
    chains.append(walking.select(*EDGE, F.lit(top).alias("level"), F.col("comp").alias("chain")))
    every = chains[0]
    for c in chains[1:]:
        every = every.unionByName(c)
    placed = in_order(every, ["level", "chain"], EDGE)
    held = hung[0].withColumn("size", F.lit(1).cast("long"))
    # What hangs on an edge: both sides' chains, or one, the other side being the edge before it in its own chain.
    weights = held.groupBy("on").agg(F.sum("size").alias("below"))
    sized = None
    for level in range(1, top + 1):
        here = placed.filter(F.col("level") == level).withColumn("on", _edge()).join(weights, "on")
        here = stored(summed(here, ["level", "chain"], "below").withColumnRenamed("sum", "size"))
        sized = here if sized is None else sized.unionByName(here)
        if level < top:
            held = here.filter("rank = n - 1").select("chain", "size").join(hung[level], "chain")
            weights = weights.unionByName(held.groupBy("on").agg(F.sum("size").alias("below")))
            weights = stored(weights.groupBy("on").agg(F.sum("below").alias("below")))
    above = sized.select("level", "chain", (F.col("rank") - 1).alias("rank"), _edge().alias("next"))
    over = hung[0]
    for h in hung[1:]:
        over = over.unionByName(h)
    nodes = sized.drop("on").join(above, ["level", "chain", "rank"], "left").join(over, ["level", "chain"], "left").select(*EDGE, F.coalesce("next", "on").alias("up"), "size")
    return stored(nodes), hung[0].select(F.col("chain").alias("id"), F.col("on").alias("up"))


@tidied
def clusters(points: DataFrame, min_cluster_size: int = 5, min_samples: int = 1) -> DataFrame:
    """(id, cluster, strength) of points(id, vec array<double>): the most stable clusters of at least min_cluster_size points; outliers are -1.

    Clusters are numbered from 0, largest first, ties by their least id. strength is the
    density at which a point leaves its cluster as a share of the cluster's greatest; 0 for
    outliers. Ids are distinct. The whole table is never a cluster, so fewer than twice the
    least size are outliers all.
    """
    none = points.select("id", F.lit(-1).alias("cluster"), F.lit(0.0).alias("strength"))
    tree = SpanningTree(points, min_samples)
    if not tree.rounds:
        return none
    nodes, leaves = dendrogram(tree)
    nodes = nodes.withColumn("node", _edge())
    big = stored(nodes.filter(F.col("size") >= min_cluster_size).select("node", "up", "size", (1 / F.greatest(F.col("w"), F.lit(LEAST_WEIGHT))).alias("density")))
    children = big.filter("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("forks"), F.sum("size").alias("kept"))
    big = stored(big.join(children, "node", "left").fillna(0, ["forks", "kept"]))
    # A node begins a cluster where its parent forks; others are in their parent's.
    split = big.filter("forks = 2").select(F.col("node").alias("up"), F.col("density").alias("born"))
    begun = stored(big.join(split, "up", "left"))
    links = begun.select("node", F.when(F.col("up").isNull() | F.col("born").isNotNull(), F.col("node")).otherwise(F.col("up")).alias("to"))
    within = roots(links).withColumnRenamed("root", "of")
    leaving = F.when(F.col("forks") == 1, F.col("size") - F.col("kept")).otherwise(F.col("size")) * F.col("density")
    mass = big.join(within, "node").groupBy("of").agg(F.sum(leaving).alias("mass"))
    parent = within.select(F.col("node").alias("up"), F.col("of").alias("parent"))
    found = mass.join(begun.select(F.col("node").alias("of"), "up", "size", F.coalesce("born", F.lit(0.0)).alias("born")), "of").join(parent, "up", "left")
    found = stored(found.select("of", "parent", "size", (F.col("mass") - F.col("size") * F.col("born")).alias("stability")))
    chosen = _chosen(found)
    # Dust hangs at most min_cluster_size - 1 edges below a node that counts.
    small = nodes.filter(F.col("size") < min_cluster_size).select("node", F.col("up").alias("next"))
    at = leaves.select("id", F.col("up").alias("node"))
    for _ in range(min_cluster_size - 2):
        at = at.join(small, "node", "left").select("id", F.coalesce("next", "node").alias("node"))
    fallen = at.join(within, "node").join(big.select("node", "density"), "node").join(chosen, "of").select("id", "label", "density")
    if not big.limit(1).count():
        return none
    fallen = stored(fallen)
    labels = fallen.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n_points"), F.min("id").alias("first"), F.max("density").alias("most"))
    numbered = in_order(labels.withColumn("one", F.lit(0)), ["one"], [F.desc("n_points"), "first"]).select("label", F.col("rank").cast("int").alias("cluster"), "most")
    out = fallen.join(numbered, "label").select("id", "cluster", (F.col("density") / F.col("most")).alias("strength"))
    return points.select("id").join(out, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def _chosen(found: DataFrame) -> DataFrame:
    """(of, label) of clusters (of, parent, size, stability): label is the chosen cluster that a cluster is part of or null.

    From the leaves up a cluster is kept if it is at least as stable as the best of its parts;
    from the root down the first that is kept is chosen, the root itself never. Rounds are the
    logarithm of the number of clusters, however deep they are nested.
    """
    scores = _scores(found)
    parts = scores.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.sum("score").alias("parts"))
    kept = F.coalesce(F.col("stability") >= F.col("parts"), F.lit(True))
    # label is the highest that is kept from a cluster up to, but without, the one at `up`.
    at = stored(scores.join(parts, "of", "left").select("of", F.col("parent").alias("up"), F.when(F.col("parent").isNotNull() & kept, F.col("of")).alias("label")))
    while at.filter("up IS NOT NULL").limit(1).count():
        over = at.select(F.col("of").alias("up"), F.col("up").alias("next"), F.col("label").alias("over"))
        at = stored(at.join(over, "up", "left").select("of", F.col("next").alias("up"), F.coalesce("over", "label").alias("label")))
    return at.select("of", "label")


def _scores(found: DataFrame) -> DataFrame:
    """(of, parent, stability, score) of clusters with two parts or none: score is the stability or the sum of the parts' scores, whichever is greater.

    Once one part has its score, a cluster's is greatest(least, more + that of the other part,
    rest). Where rest is of this kind too the two are joined into one, so a chain of any
    length is halved in each round; where rest has a score the cluster has.
    """
    kind = found.schema["of"].dataType
    inner = found.filter("parent IS NOT NULL").select(F.col("parent").alias("of")).distinct().withColumn("inner", F.lit(True))
    at = found.join(inner, "of", "left").select("of", "parent", "stability", F.when(F.col("inner").isNull(), F.col("stability")).alias("score"))
    at = stored(at.withColumns({"least": F.lit(None).cast("double"), "more": F.lit(None).cast("double"), "rest": F.lit(None).cast(kind)}))
    while at.filter("score IS NULL").limit(1).count():
        parts = at.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count("score").alias("known"), F.sum("score").alias("parts"), F.max(F.when(F.col("score").isNull(), F.col("of"))).alias("other"))
        below = at.select(F.col("of").alias("rest"), F.col("score").alias("s"), F.col("least").alias("l"), F.col("more").alias("m"), F.col("rest").alias("r"))
        chained, fresh, joined = F.col("rest").isNotNull(), F.col("rest").isNull() & (F.col("known") == 1), F.col("r").isNotNull()
        score = F.coalesce("score", F.when(chained, F.when(F.col("s").isNotNull(), F.greatest("least", F.col("more") + F.col("s")))).when(F.col("known") == 2, F.greatest("stability", "parts")))
        at = at.join(parts, "of", "left").join(below, "rest", "left").select(
            "of",
            "parent",
            "stability",
            score.alias("score"),
            F.when(fresh, F.col("stability")).when(joined, F.greatest("least", F.col("more") + F.col("l"))).otherwise(F.col("least")).alias("least"),
            F.when(fresh, F.col("parts")).when(joined, F.col("more") + F.col("m")).otherwise(F.col("more")).alias("more"),
            F.when(fresh, F.col("other")).when(joined, F.col("r")).otherwise(F.col("rest")).alias("rest"),
        )
        at = stored(at)
    return at.select("of", "parent", "stability", "score")
