"""Hilbert-curve ordering and sharding (operator 9).

Several metadata dimensions are quantised to equal bit widths and folded into one
Hilbert index; the rows are sorted by it and the order is cut into runs. Rows that
are near in any of the dimensions share files, so min/max statistics prune on all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvella.llm.store import Cuts, shuffle_width


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of integer coordinates in [0, 2**bits); len(dims) * bits must stay below 64.

    The transposed form of the index is found by undoing the curve's rotations from
    the highest bit down and Gray-coding the result; its bits are then interleaved.
    """
    n = len(dims)
    if n * bits > 63:
        raise ValueError("the index must fit 63 bits")
    start = F.array(*[d.cast("long") for d in dims])
    turns = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        below = s["q"] - 1
        own, first = F.get(x, s["i"]), F.get(x, F.lit(0))
        swap = first.bitwiseXOR(own).bitwiseAND(below)
        return F.transform(
            x,
            lambda v, j: F.when(own.bitwiseAND(s["q"]) != 0, F.when(j == 0, v.bitwiseXOR(below)).otherwise(v)).otherwise(F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v)),
        )

    def gray(x: Column) -> Column:
        return F.transform(x, lambda v, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))

    def untwist(x: Column) -> Column:
        levels = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
        twist = F.aggregate(levels, F.lit(0).cast("long"), lambda t, q: F.when(F.get(x, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(x, lambda v: v.bitwiseXOR(twist))

    def interleave(x: Column) -> Column:
        places = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(places, F.lit(0).cast("long"), lambda acc, s: F.shiftleft(acc, 1).bitwiseOR(F.when(F.get(x, s["i"]).bitwiseAND(s["q"]) != 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))

    one = lambda value, body: F.transform(value, body)  # noqa: E731  values in one-element arrays are computed once
    out = F.array(F.aggregate(turns, start, turn) if bits > 1 else start)
    return F.element_at(one(one(one(out, gray), untwist), interleave), 1)


def quantise_hash(value: Column, bits: int) -> Column:
    """A category's cell; null has one of its own kind, as its hash is the seed's."""
    return F.pmod(F.xxhash64(value), F.lit(1 << bits))


def quantise_log2(value: Column, bits: int, steps: int = 8) -> Column:
    """Cell of a non-negative number, `steps` cells to each doubling, the last open-ended."""
    return F.least(F.floor(F.log2(value + 1) * steps), F.lit((1 << bits) - 1)).cast("long")


def shard_by_curve(rows: DataFrame, dims: list[Column], ties: list[str], n_shards: int = 8, bits: int = 8, keep: list[str] | None = None) -> DataFrame:
    """Adds shard (0 to n_shards - 1), slot (gapless from 0 in each shard) and curve to the columns `keep` of rows.

    Shards are runs of the order by curve index, then `ties`, then the row's place in
    the input table; their counts are at most one apart. The order is found by one range
    exchange of narrow rows. Rows equal in every column are told apart by their place,
    so a value or a row that fills a third of the table is cut like any other.
    An empty table gives an empty result.
    """
    spark = rows.sparkSession
    cuts = Cuts(spark, "shards")
    keep = keep or rows.columns
    placed = cuts.cut(rows.select(*keep, hilbert_index(dims, bits).alias("curve")).withColumn("__at", F.monotonically_increasing_id()), "placed")
    order = ["curve", *ties, "__at"]
    ranged = placed.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    ranged = cuts.cut(ranged.withColumn("__row", F.monotonically_increasing_id()).drop("__at"), "ranged")
    cuts.drop(placed)
    part = F.shiftright("__row", 33)
    # One row for each partition of the range exchange: as many as spark.sql.shuffle.partitions at most.
    counts = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"), F.sum("__n").over(W.partitionBy()).alias("__all"))
    rank = F.col("__before") + F.col("__row").bitwiseAND((1 << 33) - 1)
    shard = F.expr(f"(__rank * {n_shards}) div __all")
    first = F.expr(f"(shard * __all + {n_shards - 1}) div {n_shards}")
    out = ranged.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("__rank", rank).withColumn("shard", shard)
    return out.select(*keep, "curve", F.col("shard").cast("int").alias("shard"), (F.col("__rank") - first).alias("slot"))


def _dims(rows: DataFrame, bits: int) -> list[Column]:
    """Cells of source, language, size (rows have it) and doc_id; the last is its place between the least and the greatest id."""
    # As doubles, ids that lie far apart have a span.
    span = rows.agg(F.min(F.col("doc_id").cast("double")).alias("lo"), F.max(F.col("doc_id").cast("double")).alias("hi")).first()
    lo, width = span["lo"] or 0.0, max(1.0, (span["hi"] or 0.0) - (span["lo"] or 0.0) + 1.0)
    cell = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(lo)) / F.lit(width) * (1 << bits)), F.lit(0))
    return [quantise_hash(F.col("source"), bits), quantise_hash(F.col("lang"), bits), quantise_log2(F.col("size"), bits), F.least(cell, F.lit((1 << bits) - 1))]


def _size() -> Column:
    return (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long")


def shard_documents(docs: DataFrame, n_shards: int = 8, bits: int = 8) -> DataFrame:
    """Shards of documents(doc_id, text, lang, source) by the curve over doc_id, language, source and size.

    Law "rows": shard counts are at most one apart. Null text has size 1 (no bytes, one
    separator) and the checksum of no bytes; null doc_id, lang and source fall into cells
    of their own; repeated rows each get a slot. Other columns of docs are not read.
    """
    small = docs.select("doc_id", "lang", "source", _size().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard_by_curve(small, _dims(small, bits), ["doc_id", "text_crc32"], n_shards, bits, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, rows_per_file: int = 1_000_000, bits: int = 8) -> None:
    """Writes whole documents, all columns, under path/shard=N, each file a run of the curve of about rows_per_file rows.

    One range exchange; every row is written once, repeated ones too. Files are near equal,
    not exactly: exact shards are those of shard_documents.
    """
    names = docs.columns
    sized = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("__row"), "doc_id", "lang", "source", _size().alias("size"))
    files = max(n_shards, -(-docs.count() // rows_per_file))
    placed = sized.withColumn("__curve", hilbert_index(_dims(docs.select("doc_id"), bits), bits))
    ranged = placed.repartitionByRange(files, "__curve", "doc_id").sortWithinPartitions("__curve", "doc_id")
    shard = F.expr(f"cast(spark_partition_id() * {n_shards} div {files} as int)")
    ranged.select(*[F.col("__row").getField(c).alias(c) for c in names], shard.alias("shard")).write.partitionBy("shard").option("maxRecordsPerFile", 2 * rows_per_file).parquet(path)
