"""Mixing sources to target weights by a time-varying curriculum (operator 11).

Each source has a weight for every moment of the run. The integral of that schedule is its
share; what a share asks for beyond so many repeats of its source goes to the others. The
schedule's running integral, scaled to the target, is the source's cumulative demand of
tokens. A source's documents, in a fixed random order and as often as the target needs them,
are one stream of tokens; inverting the demand at a copy's place in the stream gives the
moment of the run at which the copy is due, and the mix is the documents sorted by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvella.llm.columns import carried, words
from corvella.llm.places import in_order
from corvella.llm.store import Cuts, few, shuffle_width


@dataclass(frozen=True)
class Schedule:
    """A weight over the run: straight lines between (moment, weight) knots, moments from 0 to 1."""

    knots: tuple[tuple[float, float], ...]

    def __post_init__(self):
        at = [t for t, _ in self.knots]
        if len(at) < 2 or at[0] != 0 or at[-1] != 1 or any(a >= b for a, b in zip(at, at[1:], strict=False)):
            raise ValueError("moments must ascend from 0 to 1")
        if any(w < 0 for _, w in self.knots) or self.integral() <= 0:
            raise ValueError("weights must not be negative, nor all be zero")

    def lines(self) -> list[tuple[float, float, float, float]]:
        """(integral before, moment, weight, slope) of each line."""
        out, done = [], 0.0
        for (t, w), (u, x) in zip(self.knots, self.knots[1:], strict=False):
            out.append((done, float(t), float(w), (x - w) / (u - t)))
            done += (w + x) / 2 * (u - t)
        return out

    def integral(self) -> float:
        return sum((w + x) / 2 * (u - t) for (t, w), (u, x) in zip(self.knots, self.knots[1:], strict=False))


#: Shares of 5, 2 and 1: the first kind of source fades, the second stays, the third comes in.
CURRICULUM = (Schedule(((0, 6), (1, 4))), Schedule(((0, 2), (1, 2))), Schedule(((0, 0), (1, 2))))

#: The most often that a document is taken.
REPEATS = 3


def targets(sized: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target, kind) of rows (source, size): one row a source, null last.

    Sources in the order of their code points have the schedules in turn; kind is the number of
    a source's. A target is its share of all sizes, by the integral of its schedule, but at
    most `repeats` times its size; the excess goes to the others by weight until none is above.
    With sources by the sizes that their weight can hold, those below the final level are full:
    the level is the greatest of what each place in that order would leave for the rest.
    """
    weights = F.array(*[F.lit(float(s.integral())) for s in schedules])
    # From here one row a source.
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = found.withColumn("kind", (F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1) % len(schedules))
    found = found.withColumn("__w", F.get(weights, F.col("kind"))).withColumn("__most", F.col("source_size") * repeats)
    by = W.orderBy(F.col("__most") / F.col("__w"), F.col("source").isNull(), "source")
    full = F.coalesce(F.sum("__most").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("__w").over(by.rowsBetween(0, W.unboundedFollowing))
    found = found.withColumn("__level", (F.sum("source_size").over(W.partitionBy()) - full) / rest)
    level = F.max("__level").over(W.partitionBy())
    return found.select("source", "source_size", F.least(F.col("__most").cast("double"), level * F.col("__w")).alias("target"), "kind")


def moment(demand: Column, lines: Column) -> Column:
    """When the integral of a schedule's lines comes to `demand`."""
    line = F.element_at(F.filter(lines, lambda s: s["done"] <= demand), -1)
    left = demand - line["done"]
    # The root of weight * x + slope / 2 * x ** 2 = left, in the form that has no cancellation.
    root = F.sqrt(F.greatest(F.lit(0.0), line["weight"] * line["weight"] + 2 * line["slope"] * left))
    return F.least(F.lit(1.0), line["moment"] + F.when(left > 0, 2 * left / (line["weight"] + root)).otherwise(0.0))


def _copies(schedules: Sequence[Schedule], repeats: int) -> Column:
    """The copies of a row that the mix takes, given before, size, source_size, target and kind: (epoch, words, position)."""
    struct = lambda s: F.struct(*[F.lit(v).alias(k) for k, v in zip(("done", "moment", "weight", "slope"), s, strict=True)])
    lines = F.get(F.array(*[F.array(*[struct(line) for line in s.lines()]) for s in schedules]), F.col("kind"))
    whole = F.get(F.array(*[F.lit(float(s.integral())) for s in schedules]), F.col("kind"))
    wanted = F.floor(F.col("target") + 0.5)

    def copy(epoch: Column) -> Column:
        at = epoch * F.col("source_size") + F.col("before")
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), wanted - at))
        return F.struct(epoch.alias("epoch"), taken.alias("words"), F.when(taken > 0, moment(at / F.col("target") * whole, lines)).alias("position"))

    return F.filter(F.transform(F.array(*[F.lit(e) for e in range(repeats)]), copy), lambda c: c["words"] > 0)


def _streamed(rows: DataFrame, cuts: Cuts, schedules: Sequence[Schedule], repeats: int) -> DataFrame:
    """rows (doc_id, source, size and others) with source_size, target and copies.

    The order within a source is that of the MD5 of id and size.
    """
    drawn = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string")))
    ordered = in_order(rows.withColumn("__drawn", drawn), cuts, ["source"], ["__drawn", "doc_id", "size"], "size").drop("rank", "n", "total", "__drawn")
    known = cuts.cut(targets(ordered, schedules, repeats).withColumnRenamed("source", "__of"), "targets")
    return ordered.join(few(known), F.col("source").eqNullSafe(F.col("__of"))).withColumn("copies", _copies(schedules, repeats))


def mix(docs: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, position) of each row of docs(doc_id, source, text), sorted by position.

    size is the number of words. taken counts the words that the mix takes of the document,
    repeats counted: all of it in so many of its `copies`, and of the copy at the target's end
    only what is still wanted, so that a source's taken words are its target rounded.
    position is the moment (0 to 1) at which its first copy is due; rows that are not taken
    have none and come first. A null text has size 0, and such rows take no part; null sources
    are one source, the last; rows equal in id, source and size have places of their own. An
    empty table gives an empty result. Other columns are not read. The result depends on the
    rows alone, not on how they are stored.
    """
    cuts = Cuts(docs.sparkSession, "mix")
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    found = _streamed(sized, cuts, schedules, repeats)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    out = found.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("copies").alias("copies"), F.get("copies", F.lit(0))["position"].alias("position"), "source", "before")
    # Rows without a position are told apart by their places in the streams, so no range is one value.
    by = ["position", F.xxhash64("source", "before"), "doc_id"]
    return out.repartitionByRange(shuffle_width(docs.sparkSession), *by).sortWithinPartitions(*by).drop("source", "before")


def training_order(docs: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: whole rows of docs, one for each copy taken, with epoch, words (how many of the text are taken) and position, sorted by position.

    Columns of docs that have these names are replaced. Texts go through the exchanges that
    the order needs and through the final one. Nulls, repeats and empty tables are as in mix().
    """
    cuts = Cuts(docs.sparkSession, "training-order")
    whole = carried(docs, doc_id=F.col("doc_id"), source=F.col("source"), size=F.size(words(F.col("text"))).cast("long"))
    found = _streamed(whole, cuts, schedules, repeats).select("__row", F.inline("copies"))
    names = [c for c in docs.columns if c not in ("epoch", "words", "position")]
    out = found.select(*[F.col("__row").getField(c).alias(c) for c in names], "epoch", "words", "position")
    return out.repartitionByRange(shuffle_width(docs.sparkSession), "position", "doc_id", "epoch").sortWithinPartitions("position", "doc_id", "epoch")
