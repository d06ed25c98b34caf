"""Topics: timelines, hierarchy, clustering substitutes and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvella.operators.cut import stored, tidied


def by_year(doc_topics: DataFrame, docs: DataFrame, k: int = 10, parents: DataFrame | None = None) -> DataFrame:
    """topic_id, year, n of the k topics with most documents, outliers apart; parents(topic_id, parent) replaces topics."""
    rows = doc_topics.filter("topic_id <> -1")
    if parents is not None:
        rows = rows.join(F.broadcast(parents), "topic_id").withColumn("topic_id", F.col("parent"))
    best = rows.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic_id").limit(k).select("topic_id")
    dated = docs.filter(F.col("year").isNotNull()).select("doc_id", "year")
    return rows.join(F.broadcast(best), "topic_id", "left_semi").join(dated, "doc_id").groupBy("topic_id", "year").agg(F.count(F.lit(1)).alias("n"))


def periods(yearly: DataFrame, width: int = 5) -> DataFrame:
    """topic_id, period, n: the years' counts in bins of `width` years from the first year of all on."""
    first = yearly.agg(F.min("year").alias("y")).first()["y"]
    start = F.expr(f"{first or 0} + ((year - {first or 0}) div {width}) * {width}")
    return yearly.groupBy("topic_id", start.cast("int").alias("period")).agg(F.sum("n").alias("n"))


def centroids(vectors: DataFrame, places: int = 6) -> DataFrame:
    """label, dim, mean, n in long form."""
    long = vectors.select("label", F.posexplode("embedding").alias("dim", "x"))
    return long.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), places).alias("mean"), F.count(F.lit(1)).alias("n"))


def cosine_pairs(vectors: DataFrame) -> DataFrame:
    """label_a, label_b, cosine of topic centroids; topics are few, and meet on their dimensions."""
    long = vectors.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    size = long.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("s"))
    a, b = long.withColumnsRenamed({"label": "label_a", "m": "ma"}), long.withColumnsRenamed({"label": "label_b", "m": "mb"})
    dots = a.join(b, "dim").filter("label_a < label_b").groupBy("label_a", "label_b").agg(F.sum(F.col("ma") * F.col("mb")).alias("dot"))
    sa, sb = size.withColumnsRenamed({"label": "label_a", "s": "sa"}), size.withColumnsRenamed({"label": "label_b", "s": "sb"})
    return dots.join(sa, "label_a").join(sb, "label_b").select("label_a", "label_b", F.round(F.col("dot") / (F.col("sa") * F.col("sb")), 6).alias("cosine"))


def ward_linkage(points: list[list[float]], sizes: list[int]) -> list[tuple[int, int, float, int]]:
    """Ward's merges of topic centroids, nearest first: (node, node, distance, size). Topics are tens, so this is driver work."""
    live = {i: (p, n) for i, (p, n) in enumerate(zip(points, sizes, strict=True))}
    merges: list[tuple[int, int, float, int]] = []
    while len(live) > 1:
        best = None
        nodes = sorted(live)
        for x, i in enumerate(nodes):
            for j in nodes[x + 1 :]:
                (p, n), (q, m) = live[i], live[j]
                d = (2 * n * m / (n + m) * sum((a - b) ** 2 for a, b in zip(p, q, strict=True))) ** 0.5
                if best is None or d < best[0]:
                    best = (d, i, j)
        d, i, j = best
        (p, n), (q, m) = live.pop(i), live.pop(j)
        live[len(points) + len(merges)] = ([(a * n + b * m) / (n + m) for a, b in zip(p, q, strict=True)], n + m)
        merges.append((i, j, d, n + m))
    return merges


def cut_hierarchy(leaves: list[int], merges: list[tuple[int, int, float, int]], k: int = 10) -> dict[int, int]:
    """Leaf to parent (0, 1, ...) after the first merges have left k groups; parents are numbered by their first leaf."""
    n = len(leaves)
    root = list(range(n + len(merges)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for m, (i, j, *_) in enumerate(merges[: max(0, n - k)]):
        root[find(i)] = root[find(j)] = n + m
    number: dict[int, int] = {}
    return {leaf: number.setdefault(find(at), len(number)) for at, leaf in enumerate(leaves)}


def parents(vectors: DataFrame, k: int = 4) -> DataFrame:
    """topic_id, parent: topics grouped by Ward's linkage of their centroids. One row a topic comes to the driver."""
    rows = centroids(vectors, 12).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("c"), F.max("n").alias("n")).orderBy("label").collect()
    merges = ward_linkage([[x["mean"] for x in r["c"]] for r in rows], [r["n"] for r in rows])
    to = cut_hierarchy([r["label"] for r in rows], merges, k)
    return vectors.sparkSession.createDataFrame(sorted(to.items()), "topic_id int, parent int")


def display_label(label: Column) -> Column:
    """A topic's label as shown: without its number, blanks for underscores."""
    return F.coalesce(F.nullif(F.replace(F.regexp_replace(label, "^-?[0-9]+_", ""), F.lit("_"), F.lit(" ")), F.lit("")), label)


def outlier_last(topics: DataFrame) -> DataFrame:
    """topics in their order of document count, the outlier topic last."""
    return topics.orderBy((F.col("topic_id") == -1).asc(), F.desc("doc_count"), "topic_id")


def best_label(candidates: DataFrame, least: int = 80) -> DataFrame:
    """topic_id, label, score: the best candidate(topic_id, label, score, warnings, created) of each topic that passes."""
    passing = candidates.filter((F.col("score") >= least) & (F.size("warnings") == 0))
    n = F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("score"), F.desc("created"), "label"))
    return passing.withColumn("n", n).filter("n = 1").select("topic_id", "label", "score")


def first_titles(rows: DataFrame, k: int = 5) -> DataFrame:
    """topic_id, rank, title: the k distinct titles of the highest probability of each topic; rows(topic_id, title, probability)."""
    best = rows.groupBy("topic_id", "title").agg(F.max("probability").alias("p"))
    n = F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("p"), "title"))
    return best.withColumn("rank", n).filter(F.col("rank") <= k).select("topic_id", "rank", "title")


def samples(rows: DataFrame, k: int = 3) -> DataFrame:
    n = F.row_number().over(W.partitionBy("topic_id").orderBy("doc_id"))
    return rows.withColumn("rank", n).filter(F.col("rank") <= k).select("topic_id", "rank", "doc_id")


def tree_nodes(merges: DataFrame, n_leaves: int) -> DataFrame:
    """node, left_node, right_node, distance, is_root of merges(step, a, b, distance): leaves are 0 to n_leaves - 1, step m makes node n_leaves + m."""
    spark = merges.sparkSession
    inner = merges.select((F.col("step") + n_leaves).cast("long").alias("node"), F.col("a").cast("long").alias("left_node"), F.col("b").cast("long").alias("right_node"), "distance", (F.col("step") == n_leaves - 2).alias("is_root"))
    none = F.lit(None).cast("long")
    leaves = spark.range(n_leaves).select(F.col("id").alias("node"), none.alias("left_node"), none.alias("right_node"), F.lit(0.0).alias("distance"), F.lit(n_leaves == 1).alias("is_root"))
    return leaves.unionByName(inner)


def kmeans(vectors: DataFrame, k: int = 10, seed: int = 7) -> DataFrame:
    """vec_id, cluster by k-means; it stands in for density clustering, which Spark has not."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


def plane(vectors: DataFrame) -> DataFrame:
    """vec_id, x, y: the first two principal components; they stand in for a non-linear projection."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    out = PCA(k=2, inputCol="features", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def class_weights(uses: DataFrame) -> DataFrame:
    """topic_id, term, weight of uses(topic_id, term, n): class-wise TF-IDF.

    A topic's share of uses that a term has, times ln(1 + mean uses of a topic / uses of the
    term in all topics). uses is read several times, so it is stored once.
    """
    uses = stored(uses)
    sizes = uses.groupBy("topic_id").agg(F.sum("n").alias("size"))
    terms = uses.groupBy("term").agg(F.sum("n").alias("all"))
    # One row.
    mean = sizes.agg(F.avg("size")).first()[0] or 0.0
    both = uses.join(terms, "term").join(sizes, "topic_id")
    return both.select("topic_id", "term", (F.col("n") / F.col("size") * F.log(1 + F.lit(float(mean)) / F.col("all"))).alias("weight"))


def topic_terms(weights: DataFrame, k: int = 10) -> DataFrame:
    """topic_id, rank, term, weight: the k terms of most weight of each topic; ties by term."""
    rounded = weights.withColumn("weight", F.round("weight", 9))
    rank = F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("weight"), "term"))
    return rounded.withColumn("rank", rank).filter(F.col("rank") <= k).select("topic_id", "rank", "term", "weight")


@tidied
def reassigned(uses: DataFrame, assigned: DataFrame, least: float = 0.15) -> DataFrame:
    """doc_id, topic_id: assigned(doc_id, topic_id) with outliers (-1) moved to the topic whose terms they share.

    uses(doc_id, term, n) are the documents' terms. An outlier's terms are weighed as a topic's
    are; it goes to the topic of the greatest cosine, ties to the smaller topic, if that is
    `least` or more. Only outliers' terms meet the topics', in an equi-join on the term. The
    terms are found once: their sums by topic and the outliers' own ones are stored.
    """
    placed = stored(uses.join(assigned, "doc_id"))
    by_topic = stored(placed.groupBy("topic_id", "term").agg(F.sum("n").alias("n")))
    weights = class_weights(by_topic).filter("topic_id <> -1")
    norms = weights.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    mean = by_topic.groupBy("topic_id").agg(F.sum("n").alias("size")).agg(F.avg("size")).first()[0] or 0.0
    terms = by_topic.groupBy("term").agg(F.sum("n").alias("all"))
    loose = placed.filter("topic_id = -1").select("doc_id", "term", "n")
    size = loose.groupBy("doc_id").agg(F.sum("n").alias("size"))
    own = loose.join(size, "doc_id").join(terms, "term").select("doc_id", "term", (F.col("n") / F.col("size") * F.log(1 + F.lit(float(mean)) / F.col("all"))).alias("own"))
    length = own.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("length"))
    dots = own.join(weights, "term").groupBy("doc_id", "topic_id").agg(F.sum(F.col("own") * F.col("weight")).alias("dot"))
    near = dots.join(norms, "topic_id").join(length, "doc_id").withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("length")), 9)).filter(F.col("cosine") >= least)
    best = near.groupBy("doc_id").agg(F.max_by("topic_id", F.struct("cosine", -F.col("topic_id"))).alias("to"))
    return assigned.join(best, "doc_id", "left").select("doc_id", F.coalesce("to", "topic_id").alias("topic_id"))


def published(candidates: DataFrame, overridden: DataFrame, least: int = 80) -> DataFrame:
    """candidates(id, topic_id, label, score, created, status, warned) after publishing: the best passing one of each topic is auto_selected, its others rejected.

    Topics of overridden(topic_id) and those without a passing candidate stay as they are.
    Candidates that were rejected are not considered.
    """
    able = candidates.filter(F.col("status").isin("pending", "selected", "auto_selected") & (F.col("score") >= least) & ~F.col("warned"))
    best = able.join(overridden, "topic_id", "left_anti").groupBy("topic_id").agg(F.max(F.struct("score", "created", "id")).alias("b")).select("topic_id", F.col("b.id").alias("chosen"))
    both = candidates.join(best, "topic_id", "left")
    status = F.when(F.col("chosen").isNull(), F.col("status")).when(F.col("id") == F.col("chosen"), "auto_selected").otherwise("rejected")
    return both.withColumn("status", status).drop("chosen")


def selected(candidates: DataFrame, topic_id: int, chosen: int) -> DataFrame:
    """candidates after one is selected by hand: it is selected, the others of its topic are rejected. One of another topic changes nothing."""
    known = candidates.filter((F.col("id") == chosen) & (F.col("topic_id") == topic_id)).select("topic_id")
    both = candidates.join(F.broadcast(known.withColumn("__hit", F.lit(True))), "topic_id", "left")
    status = F.when(F.col("__hit"), F.when(F.col("id") == chosen, "selected").otherwise("rejected")).otherwise(F.col("status"))
    return both.withColumn("status", status).drop("__hit")


def overridden(overrides: DataFrame, topics: DataFrame, given: DataFrame, now: str) -> DataFrame:
    """overrides(topic_id, label, source, candidate_id, created_at, updated_at) with labels set by hand merged in.

    given(topic_id, label, candidate_id): a candidate's label where candidate_id is known, else
    a text of one's own. Blank texts and topics that topics(topic_id) has not change nothing; a
    topic's first override keeps its time of creation. Of several labels for a topic the
    greatest counts.
    """
    fresh = given.withColumn("label", F.trim("label")).filter("label <> ''").join(topics.select("topic_id").distinct(), "topic_id", "left_semi")
    fresh = fresh.groupBy("topic_id").agg(F.max(F.struct("label", "candidate_id")).alias("g")).select("topic_id", F.col("g.label").alias("l"), F.col("g.candidate_id").alias("c"), F.lit(True).alias("new"))
    both = overrides.join(fresh, "topic_id", "full_outer")
    put = lambda new, c: F.when(F.col("new"), new).otherwise(F.col(c)).alias(c)
    source = F.when(F.col("c").isNull(), "manual").otherwise("selected")
    return both.select("topic_id", put(F.col("l"), "label"), put(source, "source"), put(F.col("c"), "candidate_id"), F.coalesce("created_at", F.lit(now)).alias("created_at"), put(F.lit(now), "updated_at"))


def unlocked(overrides: DataFrame, topic_ids: DataFrame) -> DataFrame:
    """overrides without those of topic_ids(topic_id), whose labels are published again like any other."""
    return overrides.join(topic_ids.select("topic_id").distinct(), "topic_id", "left_anti")


def summary(doc_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """topic_id, label, n of a set of documents: outliers are uncategorised, unknown topics named by their number."""
    counts = doc_topics.filter("topic_id is not null").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(topics.select("topic_id", "label"), "topic_id", "left")
    label = F.when(F.col("topic_id") == -1, "Uncategorized").otherwise(display_label(F.coalesce("label", F.concat(F.lit("Topic "), F.col("topic_id").cast("string")))))
    return named.select("topic_id", label.alias("label"), "n")
