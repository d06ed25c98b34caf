"""The pipeline's near-copies stage against brute force over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corvella.llm import near_copies, simhash, store
from tests.llm.cases import SCHEMA, documents, empty


def classes(texts):
    """The smallest id reachable over pairs of a five-word Jaccard index of 0.8 or more."""
    sets = {i: set(near_copies.shingles(t).tolist()) for i, t in texts}
    of = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0]
    for _ in ids:
        before = dict(of)
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
        if of == before:
            return of
    return of


def edited():
    """Families of copies with a few edited words, chains of edits, documents that share one passage, and others."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]

    def edit(words, k):
        out = list(words)
        for at in rng.sample(range(len(out)), k):
            out[at] = word()
        return out

    passage, out = some(60), []
    for _ in range(12):
        base = some(rng.choice((40, 120, 250)))
        out += [base] + [edit(base, k) for k in (1, 2, 3, 4, 5, 6)]
    chain = some(200)
    for _ in range(8):
        out.append(chain)
        chain = edit(chain, 3)
    out += [passage + some(rng.randint(20, 90)) for _ in range(40)]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in texts], SCHEMA).repartition(3)


def test_classes_equal_brute_force(spark):
    texts = edited()
    want = classes(texts)
    for tile in (near_copies.TILE, 7):
        found = {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, texts), tile).collect()}
        assert found == want
    assert 20 < len(set(want.values())) < len(want)


def test_stage_drops_copies_of_few_edits(spark):
    """Copies of a Jaccard index of 0.8 to 0.9 are near copies, though their fingerprints differ by over four bits."""
    texts = edited()
    out = corpus_pipeline.near_copies(spark, frame(spark, texts), "")
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(classes(texts).values())


def test_awkward_documents(spark, monkeypatch):
    """Also with the ids to drop in a shuffled join, as where they are many."""
    docs = documents(spark, extra=True)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    # A row without id can link two others, so each is a node; the least id of a class is that of its rows with one.
    of = classes(list(enumerate(t for _, t in rows)))
    least = {}
    for at, (i, _) in enumerate(rows):
        if i is not None:
            least[of[at]] = min(i, least.get(of[at], i))
    for most in (store.FEW_ROWS, -1):
        monkeypatch.setattr(store, "FEW_ROWS", most)
        out = near_copies.keep_first(docs)
        assert out.columns == docs.columns
        kept = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(kept) - {None} == set(least.values())
        assert kept.count(None) == sum(i is None for i, _ in rows)
    assert near_copies.keep_first(empty(spark)).count() == 0


def test_links_through_rows_without_id(spark):
    """A chain whose middle has no id is one class."""
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join([*base[k:], *(f"x{j}" for j in range(k))]) for k in (0, 8, 16)]
    docs = spark.createDataFrame([(7, chain[0]), (None, chain[1]), (3, chain[2]), (None, "alone")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_copies.near_copies(docs).collect()}
    assert got == {(7, 3), (None, 3), (3, 3), (None, None)}


def test_fingerprints_do_not_lose_similar_pairs():
    """Pairs at the threshold of similarity stay far within the radius, and parities never differ in more places than the sets."""
    rng = random.Random(1)
    most = 0
    for n in (9, 18, 45, 180, 900):
        for _ in range(200):
            a = np.array(sorted(rng.getrandbits(64) for _ in range(n)), dtype=np.uint64)
            k = n // 9
            b = np.array(sorted([*rng.sample(a.tolist(), n - k), *(rng.getrandbits(64) for _ in range(k))]), dtype=np.uint64)
            x, y = (simhash.majority(simhash.ones(h), len(h)) for h in (a, b))
            most = max(most, (x ^ y).bit_count())
            p, q = (np.frombuffer(near_copies.parities(h), dtype=np.uint8) for h in (a, b))
            assert np.bitwise_count(p ^ q).sum() <= 2 * k
    assert most <= near_copies.RADIUS - 4


def test_prefix_meets_every_similar_set():
    for n in range(1, 400):
        least = -(-n * 4 // 5)
        assert near_copies.prefix(n) == n - least + 1
    assert near_copies.prefix(0) == 0
    h = near_copies.shingles("a b c d e f g")
    assert len(h) == 3 and (np.diff(h.view(np.uint64).astype(object)) > 0).all()


def test_rounds_of_nearest_candidates(spark):
    """Copies of a base that has the largest id: most pairs of copies are too far apart, and the class holds together by the base."""
    base = [f"w{i}" for i in range(150)]
    texts = [(i, " ".join([*base[: 20 + 2 * (i % 50)], f"x{i}", f"y{i}", *base[22 + 2 * (i % 50) :]])) for i in range(100)] + [(100, " ".join(base))]
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, texts), 16).collect()}
    assert found == classes(texts)


def test_one_group_of_many_copies(spark):
    """A group of copies of one document is held against its smallest, not pair by pair."""
    base = [f"w{i}" for i in range(150)]
    texts = [(i, " ".join([*base[:75], f"x{i}", *base[76:]])) for i in range(300)]
    found = near_copies.near_copies(frame(spark, texts))
    assert found.select("component_id").distinct().collect() == [(0,)]
    assert found.filter(F.col("doc_id") >= 0).count() == 300
