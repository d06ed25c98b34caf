"""Operator 11 against sums worked out by hand and by a slow version."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from corvella.llm import mixing
from corvella.llm.mixing import Schedule
from corvella.llm.places import in_order
from corvella.llm.store import Cuts
from tests.llm.cases import documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights, repeats=3):
    """The excess is reshared round by round until no target is above."""
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(repeats * sizes[s] for s in full)
        weight = sum(weights[s] for s in sizes if s not in full)
        got = {s: float(repeats * sizes[s]) if s in full else rest * weights[s] / weight for s in sizes}
        over = {s for s in sizes if s not in full and got[s] > repeats * sizes[s]}
        if not over:
            return got
        full |= over


def slow(rows, weights=(5, 2, 1)):
    """(doc_id, size, source_size, target, taken) of each row."""
    size = [len(WORD.findall(r.text or "")) for r in rows]
    sizes = defaultdict(int)
    for r, n in zip(rows, size, strict=True):
        sizes[r.source] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = shares(dict(sizes), {s: weights[i % 3] for i, s in enumerate(order)})
    out = []
    for s in order:
        stream = sorted((hashlib.md5(f"{'-' if r.doc_id is None else r.doc_id}:{n}".encode()).hexdigest(), n, r.doc_id) for r, n in zip(rows, size, strict=True) if r.source == s)
        taken, left = [0] * len(stream), int(target[s] + 0.5)
        while left > 0:
            for i, (_, n, _) in enumerate(stream):
                step = min(n, left)
                taken[i], left = taken[i] + step, left - step
        out += [(doc, n, sizes[s], round(target[s], 6), t) for (_, n, doc), t in zip(stream, taken, strict=True)]
    return Counter(out)


@pytest.mark.parametrize("extra", [False, True])
def test_mix_equals_slow_version(spark, extra):
    docs = documents(spark, extra)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == slow(docs.collect())
    assert all(r.taken <= 3 * r["size"] and (r.position is None) == (r.taken == 0) for r in got)


def test_same_rows_in_another_layout(spark):
    docs = documents(spark)
    rows = lambda d: Counter(map(tuple, mixing.mix(d).collect()))
    assert rows(docs) == rows(docs.repartition(3, "n_chars")) == rows(docs.coalesce(1))


def test_small_sources_stop_at_three_times_their_size(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s, None, None) for i, s in enumerate("a" * 2 + "b" * 50 + "c" * 50)], "doc_id long, text string, source string, lang string, n_chars long")
    got = {r.target for r in mixing.mix(docs).collect()}
    by = {r["source"]: r["target"] for r in mixing.targets(docs.selectExpr("source", "10L AS size")).collect()}
    assert by["a"] == 60 and by["b"] == pytest.approx(960 * 2 / 3) and by["c"] == pytest.approx(960 / 3) and got == set(by.values())


def test_weights_follow_the_schedule(spark):
    """In each stretch of the run the sources' words are as the integrals of their weights."""
    docs = spark.createDataFrame([(i, "w " * 5, "abc"[i % 3], None, None) for i in range(6000)], "doc_id long, text string, source string, lang string, n_chars long")
    schedules = (Schedule(((0, 6), (1, 4))), Schedule(((0, 1), (0.5, 3), (1, 1))), Schedule(((0, 0), (1, 4))))
    rows = mixing.training_order(docs, schedules).collect()
    assert len(rows) == sum(-(-round(x) // 5) for x in shares({s: 10000 for s in "abc"}, dict(zip("abc", (5, 2, 2), strict=True))).values())
    total = sum(r.words for r in rows)
    for lo, hi in ((0, 0.25), (0.25, 0.5), (0.5, 1)):
        for s, weight in zip("abc", (lambda t: 6 - 2 * t, lambda t: 1 + 4 * t if t < 0.5 else 5 - 4 * t, lambda t: 4 * t), strict=True):
            want = sum(weight(lo + (hi - lo) * (i + 0.5) / 1000) for i in range(1000)) * (hi - lo) / 1000 / 9 * total
            got = sum(r.words for r in rows if r.source == s and lo <= r.position < hi)
            assert got == pytest.approx(want, abs=0.002 * total)


def test_training_order_is_sorted_and_whole(spark):
    docs = documents(spark, extra=True)
    made = mixing.training_order(docs)
    rows = made.collect()
    assert made.columns == [*docs.columns[:5], *[c for c in docs.columns[5:] if c != "words"], "epoch", "words", "position"]
    at = [r.position for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    texts = {r.text for r in docs.collect()}
    assert {r.text for r in rows} <= texts and sum(r.words for r in rows) == sum(r.taken for r in mixing.mix(docs).collect())


def test_hot_group_of_equal_rows_and_no_words(spark):
    rows = [(None, "two words", None)] * 3000 + [(7, "", "s"), (8, None, "s")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()
    assert len(got) == 3002 and sum(r.taken for r in got) == 6000
    assert {(r["size"], r.source_size, r.target, r.taken) for r in got if r.doc_id is not None} == {(0, 0, 0.0, 0)}


def test_long_text(spark):
    got = mixing.mix(spark.createDataFrame([(1, "a " * 1_000_000, "s"), (2, "b" * 1_000_000, "s")], "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r["size"] for r in got} == {1: 1_000_000, 2: 1} and sum(r.taken for r in got) == 1_000_001


def test_empty(spark):
    assert mixing.mix(empty(spark)).collect() == [] and mixing.training_order(empty(spark)).collect() == []


@pytest.mark.parametrize("knots", [((0, 1),), ((0, 1), (0.5, 1)), ((0, 0), (1, 0)), ((0, -1), (1, 3)), ((0, 1), (0, 2), (1, 1))])
def test_schedules_that_are_none(knots):
    with pytest.raises(ValueError):
        Schedule(knots)


def test_places(spark):
    rows = [(k, i % 5, a) for i, (k, a) in enumerate([(None, 1), ("x", 2), ("x", 3), ("y", 4)] * 25)]
    got = in_order(spark.createDataFrame(rows, "k string, o int, a long").repartition(6), Cuts(spark, "places"), ["k"], ["o", "a"], "a").collect()
    for k in (None, "x", "y"):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine))) and {r.n for r in mine} == {len(mine)} and {r.total for r in mine} == {sum(r.a for r in mine)}
        assert [(r.o, r.a) for r in mine] == sorted((o, a) for x, o, a in rows if x == k)
        assert [r.before for r in mine] == [sum(r.a for r in mine[:i]) for i in range(len(mine))]
