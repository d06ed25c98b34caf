"""Operator 12 against a tree built in the plainest way."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvella.llm import manifest
from tests.llm.cases import SCHEMA, documents, empty


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def leaf(r, more=0):
    values = [r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def steps(tree, at, fan):
    """(siblings to the left, to the right) of each level."""
    for level in tree[:-1]:
        run = level[at // fan * fan : at // fan * fan + fan]
        yield "".join(run[: at % fan]), "".join(run[at % fan + 1 :])
        at //= fan


def slow(rows, fan=2):
    trees = defaultdict(list)
    for r in rows:
        trees[r.lang].append(r)
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    low = {}
    for k in order:
        trees[k].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        low[k] = levels([leaf(r) for r in trees[k]], fan)
    high = levels([low[k][-1][0] for k in order], fan)
    root = high[-1][0]
    out = []
    for t, k in enumerate(order):
        for at, r in enumerate(trees[k]):
            path = [*steps(low[k], at, fan), *steps(high, t, fan)]
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
            folded = leaf(r, 1) if tampered else leaf(r)
            for a, b in path:
                folded = sha(a + folded + b)
            out.append((r.doc_id, leaf(r), low[k][-1][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return Counter(out)


@pytest.mark.parametrize("extra", [False, True])
def test_equals_slow_version(spark, extra):
    docs = documents(spark, extra)
    got = manifest.manifest_proofs(docs).collect()
    assert Counter(map(tuple, got)) == slow(docs.collect())
    assert 0 < sum(not r.verified for r in got) < len(got) / 2


@pytest.mark.parametrize(("fan", "high", "n"), [(2, 2, 77), (3, 1, 30), (2, 10, 1025)])
def test_blocks_of_any_shape(spark, fan, high, n):
    """Rounds of few levels, lone nodes at the right edge, other fans."""
    docs = spark.createDataFrame([(i, f"t{i}", "en" if i % 9 else None, "s", i) for i in range(n)], SCHEMA).repartition(6)
    made = manifest.build(docs, fan=fan, levels=high)
    got = Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in manifest.prove(made).collect())
    want = slow(docs.collect(), fan)
    assert got == Counter({k[:5]: v for k, v in want.items()})
    assert manifest.prove(made).filter("NOT verified").count() == 0


@pytest.mark.parametrize("langs", [["en"], [None, "é", "z", "\U0001f600", "￿"]])
def test_few_leaves(spark, langs):
    """A lone leaf is its subroot, a lone subroot the root; languages are ordered by their bytes."""
    docs = spark.createDataFrame([(i, "t", k, "s", None) for i, k in enumerate(langs)], SCHEMA)
    got = manifest.manifest_proofs(docs).collect()
    assert Counter(map(tuple, got)) == slow(docs.collect())
    if len(langs) == 1:
        assert got[0].leaf == got[0].root and got[0].proof_sha256 == sha("") and got[0].verified


def test_any_changed_column_is_found(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(40)], SCHEMA)
    for column, value in {"text": F.lit("other"), "source": F.lit(None).cast("string")}.items():
        made = manifest.build(docs, F.when(F.col("doc_id") == 13, manifest.leaf_hash(**{column: value})))
        assert [r.doc_id for r in manifest.prove(made).filter("NOT verified").collect()] == [13]


def test_long_text_and_hot_rows(spark):
    docs = spark.createDataFrame([(None, "x" * 1_000_000, None, None, None)] + [(5, "same", "en", "s", 4)] * 300, SCHEMA).repartition(5)
    assert Counter(map(tuple, manifest.manifest_proofs(docs).collect())) == slow(docs.collect())


def test_greatest_count_of_characters(spark):
    assert len(manifest.manifest_proofs(spark.createDataFrame([(14, "t", "en", "s", (1 << 63) - 1)] * 2, SCHEMA)).collect()) == 2


def test_empty(spark):
    assert manifest.manifest_proofs(empty(spark)).collect() == []
