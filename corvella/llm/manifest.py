"""A Merkle manifest of a dataset by parent-preimage paths (operator 12).

The manifest stores, for each parent, the concatenated hashes of its children: what its own
hash is the hash of. A leaf joins the preimages of its ancestors. Taking its own slot of 64
characters out of each leaves its siblings, which are its proof; putting another hash into
the slot and hashing again, level by level, folds that hash to a root.

Parents of ten levels are stored as one row a block of 1024 consecutive nodes, so 10**10
leaves are four rounds, and no task holds more than a block and one path.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvella.llm.places import in_order
from corvella.llm.store import Cuts, few

#: Children of a parent, and levels that are stored as one row.
FAN, LEVELS = 2, 10

#: Characters of a hash.
SLOT = 64

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(**other: Column) -> Column:
    """The leaf of a row; `other` stands for the columns of these names."""
    return F.sha2(F.concat(*[encoded(other.get(c, F.col(c))) for c in FIELDS]), 256)


def _depth(n: int, fan: int, levels: int) -> int:
    """How many levels a block of a tree of n nodes rises."""
    deep = 0
    while n > 1 and deep < levels:
        n, deep = -(-n // fan), deep + 1
    return deep


def ancestors(preimages: list[str], i: int, fan: int) -> list[tuple[str, int]]:
    """(preimage, own slot) of each ancestor in the block of its i-th node, from the parent up; preimages has each level's hashes as one string."""
    out = []
    for text in preimages:
        parent = i // fan
        out.append((text[parent * fan * SLOT : (parent + 1) * fan * SLOT], i % fan))
        i = parent
    return out


def excised(preimage: str, slot: int) -> str:
    """The siblings' hashes, left to right."""
    return preimage[: slot * SLOT] + preimage[(slot + 1) * SLOT :]


def spliced(preimage: str, slot: int, other: str) -> str:
    return preimage[: slot * SLOT] + other + preimage[(slot + 1) * SLOT :]


BLOCKS = "tree string, at long, n long, hash string, preimages array<string>"


def _rise(nodes: DataFrame, cuts: Cuts, fan: int, levels: int) -> list[DataFrame]:
    """The blocks of each round over nodes (tree, at, n, hash): at is a node's place in its tree of n; a block is a node of the next round."""
    size = fan**levels

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        n, level, held = int(rows["n"].iloc[0]), rows["hash"].tolist(), []
        for _ in range(_depth(n, fan, levels)):
            held.append("".join(level))
            level = [_h(held[-1][i : i + fan * SLOT]) for i in range(0, len(held[-1]), fan * SLOT)]
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "at": int(rows["at"].iloc[0]) // size, "n": -(-n // size), "hash": level, "preimages": [held]})

    most, rounds = nodes.agg(F.max("n")).first()[0], []
    while most:
        blocks = nodes.groupBy("tree", F.expr(f"at div {size}").alias("__block")).applyInPandas(block, BLOCKS)
        rounds.append(cuts.cut(blocks, f"round-{len(rounds)}"))
        nodes, most = rounds[-1].drop("preimages"), 0 if most <= size else -(-most // size)
    return rounds


PATHS = "tree string, at long, above array<string>, slots array<int>"


def _descend(rounds: list[DataFrame], above: DataFrame, fan: int, levels: int) -> DataFrame:
    """Blocks of the first round with above and slots: the preimages over each block and the own slots in them. `above` has those of the last round."""
    size = fan**levels

    def below(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        preimages = list(row["preimages"])
        held = len(preimages[0]) // SLOT if preimages else 1
        own = [ancestors(preimages, i, fan) for i in range(held)]
        return pd.DataFrame(
            {
                "tree": row["tree"],
                "at": [int(row["at"]) * size + i for i in range(held)],
                "above": [[p for p, _ in x] + list(row["above"]) for x in own],
                "slots": [[s for _, s in x] + list(row["slots"]) for x in own],
            }
        )

    for blocks in reversed(rounds[1:]):
        above = blocks.join(above, ["tree", "at"]).groupBy("tree", "at").applyInPandas(below, PATHS)
    return rounds[0].join(above, ["tree", "at"])


@dataclass
class Manifest:
    """leaves (doc_id, tree, at, leaf, altered) in their order, one tree a language; blocks with all that lies above them, and subroot; the root."""

    leaves: DataFrame
    blocks: DataFrame
    root: str
    fan: int
    levels: int


def build(docs: DataFrame, altered: Column | None = None, fan: int = FAN, levels: int = LEVELS) -> Manifest | None:
    """The manifest of docs(doc_id, source, lang, n_chars, text); None for an empty table.

    altered: the hash to fold in a leaf's place, null for its own. Per language leaves ascend
    by doc_id, null first, then by hash, so that rows that repeat an id have a place each. The
    null language is a tree of its own, before all others.
    """
    cuts = Cuts(docs.sparkSession, "manifest")
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    small = docs.select(tree.alias("tree"), "doc_id", leaf_hash().alias("leaf"), (F.lit(None).cast("string") if altered is None else altered).alias("altered"))
    leaves = in_order(small, cuts, ["tree"], ["doc_id", "leaf"]).withColumnRenamed("rank", "at")
    low = _rise(leaves.select("tree", "at", "n", F.col("leaf").alias("hash")), cuts, fan, levels)
    if not low:
        return None
    # One row a language: "-" sorts before "=", and strings by their bytes.
    subroots = low[-1].select("tree", F.col("hash").alias("subroot"), (F.row_number().over(W.orderBy("tree")) - 1).cast("long").alias("at"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    subroots = cuts.cut(subroots, "subroots")
    high = _rise(subroots.select(F.lit("").alias("tree"), "at", "n", F.col("subroot").alias("hash")), cuts, fan, levels)
    none = high[-1].select("tree", "at", F.array().cast("array<string>").alias("above"), F.array().cast("array<int>").alias("slots"))
    # The rounds below the subroots have them for their nodes: one more step down.
    over = _descend([subroots.select(F.lit("").alias("tree"), "at", F.col("tree").alias("own"), "subroot"), *high], none, fan, levels)
    top = cuts.cut(over.select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("at"), "above", "slots"), "over-subroots")
    blocks = _descend(low, top, fan, levels).join(few(subroots.select("tree", "subroot")), "tree")
    return Manifest(leaves, cuts.cut(blocks, "blocks"), high[-1].first()["hash"], fan, levels)


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(made: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf; the fold takes the altered hash where there is one."""
    root, fan, size = made.root, made.fan, made.fan**made.levels

    def proved(leaves: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        held, out = blocks.iloc[0], []
        above = list(zip(held["above"], held["slots"], strict=True))
        preimages, subroot = list(held["preimages"]), held["subroot"]
        for at, leaf, altered in zip(leaves["at"].tolist(), leaves["leaf"], leaves["altered"], strict=True):
            path = ancestors(preimages, at % size, fan) + above
            folded = altered if isinstance(altered, str) else leaf
            for preimage, slot in path:
                folded = _h(spliced(preimage, slot, folded))
            out.append((leaf, subroot, root, _h("".join(excised(*step) for step in path)), folded, folded == root))
        found = pd.DataFrame(out, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        found.insert(0, "doc_id", leaves["doc_id"].to_numpy())
        return found

    # Ids as text: beside nulls, pandas would hold numbers as doubles.
    leaves = made.leaves.select("tree", F.expr(f"at div {size}").alias("block"), "at", "leaf", "altered", F.col("doc_id").cast("string"))
    return leaves.groupBy("tree", "block").cogroup(made.blocks.groupBy("tree", "at")).applyInPandas(proved, PROOFS.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def manifest_proofs(docs: DataFrame) -> DataFrame:
    """Proofs of all rows of documents, folded from tampered leaves where 7 divides the checksum of the decimal doc_id.

    Tampering adds 1 to n_chars; a null n_chars, and so the leaf, stays, as do rows without
    id. Texts may be null, empty or of any length; repeated rows are leaves of their own; a
    lone leaf is its subroot, and a lone subroot the root. An empty table gives an empty
    result. Other columns of docs are not read.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = build(docs, F.when(tampered & F.col("n_chars").isNotNull(), leaf_hash(n_chars=F.try_add(F.col("n_chars"), F.lit(1)))))
    return docs.sparkSession.createDataFrame([], PROOFS) if made is None else prove(made)
