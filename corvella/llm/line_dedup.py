"""Line deduplication over the whole corpus (operator 7).

Line hashes are range-partitioned with a secondary sort by document and position;
the sorted runs are streamed for the first occurrence in each document, and what
comes back is a sparse keep bitmap for each document that loses lines, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvella.llm.columns import BLANKS, ascii_lower, carried, hex_sha256, let, restored
from corvella.llm.store import Cuts, shuffle_width

#: Runs of one hash are cut by document into so many, so that a line that a third of the corpus holds fills many tasks.
RUNS = 1024


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _identified(docs: DataFrame) -> DataFrame:
    """Rows are told apart by doc_id and text, so repeated and null ids are no special case."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("__doc"), F.xxhash64(text).alias("__th"), text.alias("__text"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Sparse keep bitmaps of the documents that lose a line: (__doc, __th, keep, n_dropped).

    A key of at least min_chars code points found in at least min_docs documents keeps
    only its lines in the largest doc_id holding it. keep lists (word, bits): bit i of
    word w is 0 if line 64 * w + i goes; words that are not listed are all ones.
    A null doc_id counts as one document, smaller than all others.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "lines")
    lines = _identified(docs).select("__doc", "__th", F.posexplode(F.split("__text", "\n")).alias("__pos", "__line"))
    keyed = lines.filter(F.length("__line") >= min_chars).withColumn("__key", line_key(F.col("__line"))).filter(F.length("__key") >= min_chars)
    found = cuts.cut(keyed.select(F.unhex(F.md5("__key")).alias("__hash"), "__doc", "__th", "__pos"), "occurrences")
    # Largest document first: the first occurrence of a run is the one to stay.
    ranged = found.withColumn("__run", F.pmod(F.xxhash64("__doc"), F.lit(RUNS))).repartitionByRange(shuffle_width(spark), "__hash", "__run")
    run = W.partitionBy("__hash", "__run").orderBy(F.desc_nulls_last("__doc"), "__th", "__pos")
    firsts = ranged.withColumn("__n", F.row_number().over(run)).withColumn("__last", F.lag("__doc").over(run)).filter((F.col("__n") == 1) | ~F.col("__doc").eqNullSafe(F.col("__last")))
    shared = firsts.groupBy("__hash").agg(F.count(F.lit(1)).alias("__docs"), F.max("__doc").alias("__holder")).filter(F.col("__docs") >= min_docs).select("__hash", "__holder")
    # Read from a table, so that Spark can split a hot hash in the join.
    shared = cuts.cut(shared, "shared")
    gone = found.join(shared, "__hash").filter(~F.col("__doc").eqNullSafe(F.col("__holder")))
    bit = F.expr("shiftleft(1L, __pos % 64)")
    masks = gone.groupBy("__doc", "__th", F.expr("__pos div 64").cast("int").alias("__word")).agg(F.bit_or(bit).alias("__mask"))
    return masks.groupBy("__doc", "__th").agg(
        F.collect_list(F.struct(F.col("__word").alias("word"), F.bitwise_not("__mask").alias("bits"))).alias("keep"),
        F.sum(F.bit_count("__mask")).cast("long").alias("n_dropped"),
    )


def _kept_lines(lines: Column, keep: Column) -> Column:
    """Lines whose bit is set."""
    words = lambda m, n: F.transform(F.sequence(F.lit(0), ((n - 1) / 64).cast("int")), lambda w: F.coalesce(m[w], F.lit(-1).cast("long")))
    return let(lines, lambda x: let(F.map_from_entries(keep), lambda m: let(words(m, F.size(x)), lambda d: F.filter(x, lambda _, i: F.getbit(F.get(d, F.floor(i / 64).cast("int")), i % 64) == 1))))


def drop_lines(docs: DataFrame, bitmaps: DataFrame, *more: str) -> DataFrame:
    """All columns of docs, with text as the bitmaps leave it, and n_lines (before) and n_dropped where asked for in `more`.

    Null text becomes one empty line. Only the narrow bitmaps are built into hash
    tables; the texts stream by.
    """
    rows = carried(docs, __id=F.col("doc_id"), __of=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    both = rows.join(bitmaps.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__of") == F.col("__th")), "left")
    whole = F.coalesce(F.col("__row.text"), F.lit(""))
    lines = F.split(whole, "\n")
    text = F.when(F.col("keep").isNull(), whole).otherwise(F.array_join(_kept_lines(lines, F.col("keep")), "\n"))
    counts = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce("n_dropped", F.lit(0).cast("long"))}
    return restored(both, docs.columns, *[counts[c].alias(c) for c in more], text=text)


def dedup_lines(docs: DataFrame, *more: str, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with shared lines left in their largest document only; see keep_bitmaps and drop_lines."""
    return drop_lines(docs, keep_bitmaps(docs, min_chars, min_docs), *more)


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: one row for each row of docs.

    A null or empty text is one empty line. A line repeated within a document is found in one
    document; of documents that hold a key the largest id keeps all its lines, null ids count
    as one document smaller than all others. Other columns are not read; an empty table gives
    an empty result.
    """
    own = docs.select("doc_id", "text")
    return dedup_lines(own, "n_lines", "n_dropped").select("doc_id", "n_lines", "n_dropped", hex_sha256(F.col("text")).alias("kept_sha256"))
