"""Queries over the graph of documents and citations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.functions.similarity import TextTable, best_pairs, citation_year, prefix_key, similar_pairs
from corvella.operators.cut import cut
from corvella.operators.places import in_order


def top_cited(links: DataFrame, citations: DataFrame, lookups: DataFrame, limit: int = 50, least: int = 2) -> DataFrame:
    """The works cited by most documents, at least `least`, with what the catalogue said.

    Links are counted and cut to the top before the texts are joined.
    """
    counts = links.groupBy("citation_id").agg(F.countDistinct("doc_id").alias("doc_count")).filter(F.col("doc_count") >= least)
    top = counts.orderBy(F.desc("doc_count"), "citation_id").limit(limit)
    return top.join(citations, top["citation_id"] == citations["id"]).join(lookups, "citation_id", "left").select("citation_id", "text", "doc_count", "hits", "bib_id")


def with_sharing(links: DataFrame, citations: DataFrame, lookups: DataFrame, doc_id: int) -> DataFrame:
    """The citations of one document with the number of documents that share each."""
    own = links.filter(F.col("doc_id") == doc_id).select("citation_id").distinct()
    shared = links.join(own, "citation_id", "left_semi").groupBy("citation_id").agg(F.countDistinct("doc_id").alias("total_docs"))
    return shared.join(citations, shared["citation_id"] == citations["id"]).join(lookups, "citation_id", "left").select("citation_id", "text", "total_docs", "hits")


def citing(links: DataFrame, docs: DataFrame, citation_id: int) -> DataFrame:
    return links.filter(F.col("citation_id") == citation_id).join(docs, "doc_id").select("doc_id", "title", "author", "year")


def cocited(links: DataFrame, citations: DataFrame, top: int = 50, least: int = 2, limit: int = 100) -> DataFrame:
    """Pairs of the most cited works that documents cite together.

    Links are cut to the top works before they meet each other, so a document has at most
    top * (top - 1) / 2 pairs, however long its bibliography.
    """
    best = links.groupBy("citation_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "citation_id").limit(top).select("citation_id")
    kept = links.join(F.broadcast(best), "citation_id", "left_semi")
    a, b = kept.select("doc_id", F.col("citation_id").alias("id_a")), kept.select("doc_id", F.col("citation_id").alias("id_b"))
    pairs = a.join(b, "doc_id").filter(F.col("id_a") < F.col("id_b")).groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
    out = pairs.orderBy(F.desc("shared"), "id_a", "id_b").limit(limit)
    text = citations.select(F.col("id"), F.substring("text", 1, 80).alias("t"))
    return out.join(text.withColumnsRenamed({"id": "id_a", "t": "text_a"}), "id_a").join(text.withColumnsRenamed({"id": "id_b", "t": "text_b"}), "id_b").select("id_a", "id_b", "text_a", "text_b", "shared")


def network_nodes(pairs: DataFrame) -> DataFrame:
    """id, text, degree of the works that pairs tie together."""
    ends = pairs.select(F.inline(F.array(F.struct(F.col("id_a").alias("id"), F.col("text_a").alias("text")), F.struct(F.col("id_b").alias("id"), F.col("text_b").alias("text")))))
    return ends.groupBy("id", "text").agg(F.count(F.lit(1)).alias("degree"))


def pending(citations: DataFrame, lookups: DataFrame) -> DataFrame:
    """Citations to look up: those to be tried again (no hits known, a title to ask for), then those never tried."""
    again = lookups.filter(F.col("hits").isNull() & F.col("query_title").isNotNull()).join(citations, lookups["citation_id"] == citations["id"]).select("id", "text", F.lit("retry").alias("why"))
    never = citations.join(lookups, citations["id"] == lookups["citation_id"], "left_anti").select("id", "text", F.lit("new").alias("why"))
    return again.unionByName(never)


def lookup_statistics(citations: DataFrame, lookups: DataFrame) -> DataFrame:
    """One row: citations, lookups, held, absent, retryable and pending."""
    hits, title = F.col("hits"), F.col("query_title")
    seen = lookups.select(F.lit(0).alias("c"), F.lit(1).alias("l"), (hits > 0).alias("held"), (hits == 0).alias("absent"), (hits.isNull() & title.isNotNull()).alias("retry"))
    none = F.lit(False)
    both = seen.unionByName(citations.select(F.lit(1).alias("c"), F.lit(0).alias("l"), none.alias("held"), none.alias("absent"), none.alias("retry")))
    n = lambda c: F.count_if(F.col(c) == 1)
    out = both.agg(n("c").alias("citations"), n("l").alias("looked_up"), F.count_if("held").alias("held"), F.count_if("absent").alias("absent"), F.count_if("retry").alias("retryable"))
    return out.withColumn("pending", F.col("citations") - F.col("looked_up") + F.col("retryable"))


def status(lookups: DataFrame) -> DataFrame:
    hits = F.col("hits")
    return lookups.select("citation_id", F.when(hits.isNull(), "none").when(hits > 0, F.when(F.col("bib_id").isNotNull(), "held_link").otherwise("held")).otherwise("check").alias("status"))


def block_keys(texts: DataFrame) -> DataFrame:
    """id, text, year, block: the blocks in which a citation is sought: its year and those beside it, and its prefix.

    A text with a year meets others of the same prefix only if they have none.
    """
    rows = texts.withColumn("year", citation_year(F.col("text"))).withColumn("prefix", prefix_key(F.col("text")))
    years = F.transform(F.sequence(F.col("year") - 1, F.col("year") + 1), lambda y: F.concat(F.lit("y"), y.cast("string")))
    blocks = F.concat(F.coalesce(F.when(F.col("year").isNotNull(), years), F.array().cast("array<string>")), F.coalesce(F.when(F.col("prefix").isNotNull(), F.array(F.concat(F.lit("p"), "prefix"))), F.array().cast("array<string>")))
    return rows.withColumn("block", F.explode(blocks))


def canonical_keys(texts: DataFrame) -> DataFrame:
    """id, text, year, block: the one block in which a known citation stands, its year or, without one, its prefix."""
    rows = texts.withColumn("year", citation_year(F.col("text"))).withColumn("prefix", prefix_key(F.col("text")))
    key = F.when(F.col("year").isNotNull(), F.concat(F.lit("y"), F.col("year").cast("string"))).when(F.col("prefix").isNotNull(), F.concat(F.lit("p"), "prefix"))
    return rows.withColumn("block", key).filter(F.col("block").isNotNull())


#: Texts of a block that are compared with as many others at once, and the characters that these may have, about.
TILE, CHARACTERS = 1024, 1 << 22

TILED = "array<struct<id:long,text:string,n:long>>"


def _dealt(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with the tile (t) of their block in which each stands, and how many tiles each block has."""
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum(F.length("text")) / CHARACTERS)).cast("int")
    size = cut(keyed.groupBy("block").agg(tiles.alias("tiles")))
    return keyed.join(size, "block").withColumn("t", F.pmod(F.xxhash64("text"), F.col("tiles")).cast("int")).drop("tiles"), size


def _tile_pairs(new: DataFrame, known: DataFrame) -> DataFrame:
    """new, known: each two tiles of a block in arrays. Pairs of tiles are groups of their own, so a hot block is spread over all tasks."""
    (a, of_a), (b, of_b) = _dealt(new), _dealt(known)
    width = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.collect_list(F.struct("id", "text", "n")).cast(TILED)

    def side(rows: DataFrame, others: DataFrame, mine: str, theirs: str, name: str) -> DataFrame:
        mates = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias(theirs)
        met = rows.withColumnRenamed("t", mine).join(others, "block").select("block", mine, mates, "id", "text", "n")
        # A stated number of partitions is kept, however few bytes there are: the work is in the comparisons.
        return met.repartition(width, "block", "t", "u").groupBy("block", "t", "u").agg(row.alias(name))

    return side(a, of_b, "t", "u", "new").join(side(b, of_a, "u", "t", "known"), ["block", "t", "u"])


#: What is asked for each new text: all known ones that stand before it, the best one, or the first one, known ones all standing before new ones.
BEFORE, BEST, FIRST = "before", "best", "first"


def _compare(least: float, ask: str):
    """(id_new, id_known, score) of the pairs of two tiles that are similar enough, as asked for."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for new, known in zip(batch["new"], batch["known"], strict=True):
                a, b = TextTable([x["text"] for x in new]), TextTable([x["text"] for x in known])
                ids, n = (np.array([x[c] for x in known], dtype=np.int64) for c in ("id", "n"))
                own, own_n = (np.array([x[c] for x in new], dtype=np.int64) for c in ("id", "n"))
                before = lambda i, j: (n[j] > own_n[i]) | ((n[j] == own_n[i]) & (ids[j] < own[i]))  # noqa: B023, E731
                other = lambda i, j: ids[j] != own_n[i]  # noqa: B023, E731
                pairs = best_pairs(a, b, least, other) if ask == BEST else similar_pairs(a, b, least, before)
                for i, j, score in pairs:
                    found = pd.DataFrame({"id_new": own[i], "id_known": ids[j], "score": score, "less": -n[j]})
                    if ask == BEST:
                        found = found.sort_values(["id_new", "score", "id_known"], ascending=[True, False, True]).drop_duplicates("id_new")
                    if ask == FIRST:
                        found = found.sort_values(["id_new", "less", "id_known"]).drop_duplicates("id_new")
                    if len(found):
                        yield found[["id_new", "id_known", "score"]]

    return each


def fuzzy_pairs(new: DataFrame, known: DataFrame, least: float = 0.9, ask: str = BEFORE) -> DataFrame:
    """id_new, id_known, score of similar texts(id, text, n), lower-cased ones: those of one block that are similar enough.

    Blocks meet tile by tile: a row holds two arrays of about TILE texts, which are compared
    by numpy, so no row is made for a pair that is not similar. Asked for the BEST, each tile pair
    gives the best known text of each new one, and n is the id that a new text must not match;
    else known ones that stand before it, by larger n, then smaller id: all, or of each tile pair
    the FIRST.
    """
    tiles = _tile_pairs(block_keys(new).select("block", "id", "text", "n"), canonical_keys(known).select("block", "id", "text", "n"))
    return tiles.select("new", "known").mapInPandas(_compare(least, ask), "id_new long, id_known long, score double")


def best_matches(new: DataFrame, known: DataFrame, least: float = 0.9) -> DataFrame:
    """id_new, id_known, score: the most similar known citation of each new one, itself aside; ties go to the smaller id.

    Texts are compared lower-cased. A citation whose text another one has matches the
    smallest such; the texts of the others are compared once each. Empty texts match nothing.
    """
    plain = lambda d: d.select("id", F.lower("text").alias("text")).filter(F.length("text") > 0)
    a, b = plain(new), plain(known)
    one = b.groupBy("text").agg(F.min("id").alias("one"))
    two = b.join(one, "text").filter(F.col("id") != F.col("one")).groupBy("text").agg(F.min("id").alias("two"))
    held = cut(one.join(two, "text", "left"))
    met = a.join(held, "text").select("id", F.when(F.col("one") != F.col("id"), F.col("one")).otherwise(F.col("two")).alias("id_known")).filter("id_known is not null")
    own = cut(met.select(F.col("id").alias("id_new"), "id_known", F.lit(1.0).alias("score")))
    rest = cut(a.join(own.select(F.col("id_new").alias("id")), "id", "left_anti"))
    # n carries the id that is the text's own.
    zero = F.lit(0).cast("long")
    texts = rest.groupBy("text").agg(F.min("id").alias("id")).join(held, "text", "left").select("id", "text", F.coalesce("one", F.lit(-1).cast("long")).alias("n"))
    found = fuzzy_pairs(texts, held.select(F.col("one").alias("id"), "text", zero.alias("n")), least, BEST)
    best = found.groupBy("id_new").agg(F.max_by("id_known", F.struct("score", -F.col("id_known"))).alias("id_known"), F.max("score").alias("score"))
    named = best.join(texts.select(F.col("id").alias("id_new"), "text"), "id_new").select("text", "id_known", "score")
    return own.unionByName(rest.join(named, "text").select(F.col("id").alias("id_new"), "id_known", "score"))


#: Texts of the first batch, and how many times as many the batches before one come to in the next.
BATCH, GROWTH = 4096, 4


def cluster_first(texts: DataFrame, counts: DataFrame, least: float = 0.9, rounds: int = 50) -> DataFrame:
    """id, canonical: each text joins the first canonical before it that is similar enough, or is one itself.

    The order is document count, then id. Texts that are equal, lower-cased, go with the first
    of them, which is as near to any canonical as they are. Texts are taken in batches of that
    order: a batch meets the canonicals found before it, and only texts that resemble none of
    them meet each other. So pairs of texts that both follow a canonical are not compared, and
    what is compared grows with the texts times the canonicals of their blocks.
    """
    counted = texts.join(counts, texts["id"] == counts["citation_id"], "left").select("id", F.lower("text").alias("text"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    counted = cut(counted)
    first = counted.groupBy("text").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("id").alias("id"))).alias("at"))
    order = in_order(first.select(F.lit(0).alias("one"), "text", "at"), ["one"], ["at"])
    order = order.select(F.col("at.id").alias("id"), "text", (-F.col("at.less")).alias("n"), "at", "rank")
    total, done, heads = order.count(), 0, None
    while heads is None or done < total:
        upto = max(BATCH, GROWTH * done)
        batch = order.filter((F.col("rank") >= done) & (F.col("rank") < upto))
        joined = None
        if heads is not None:
            canonical = order.join(heads.filter("id = canonical").select("id"), "id", "left_semi")
            met = fuzzy_pairs(batch.filter(F.length("text") > 0), canonical.filter(F.length("text") > 0), least, FIRST)
            met = met.join(canonical.select(F.col("id").alias("id_known"), "at"), "id_known").groupBy(F.col("id_new").alias("id")).agg(F.min("at").alias("at"))
            joined = cut(met.select("id", F.col("at.id").alias("canonical")))
            batch = cut(batch.join(joined.select("id"), "id", "left_anti"))
        fresh = _settled(batch, least, rounds)
        done, heads = upto, cut(fresh if heads is None else heads.unionByName(joined).unionByName(fresh))
    placed = order.join(heads, "id").select("text", "canonical")
    return counted.select("id", "text").join(placed, "text").select("id", "canonical")


def _settled(order: DataFrame, least: float, rounds: int) -> DataFrame:
    """id, canonical of order(id, text, n, at), texts that meet each other.

    A text is canonical once all similar texts before it are known not to be; it joins the first
    canonical among them. Each round settles those that can be, so chains are as many rounds as
    they are long.
    """
    some = order.filter(F.length("text") > 0)
    pairs = fuzzy_pairs(some, some, least)
    before = cut(pairs.join(order.select(F.col("id").alias("id_known"), "at"), "id_known").select(F.col("id_new").alias("id"), F.col("id_known").alias("earlier"), "at").distinct())
    known = cut(order.select("id").join(before.select("id").distinct(), "id", "left_anti").withColumn("canonical", F.col("id")))
    for _ in range(rounds):
        settled = known.select(F.col("id").alias("earlier"), (F.col("id") == F.col("canonical")).alias("is_canonical"))
        seen = before.join(known.select("id"), "id", "left_anti").join(settled, "earlier", "left")
        judged = seen.groupBy("id").agg(F.min(F.when(F.col("is_canonical"), F.col("at"))).alias("found"), F.min(F.when(F.col("is_canonical").isNull(), F.col("at"))).alias("open"))
        # The first canonical counts once no undecided text stands before it.
        done = cut(judged.filter(F.col("open").isNull() | (F.col("found") < F.col("open"))).select("id", F.coalesce(F.col("found.id"), F.col("id")).alias("canonical")))
        if done.isEmpty():
            return known
        known = cut(known.unionByName(done))
    raise RuntimeError("clusters did not settle")
