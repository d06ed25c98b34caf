"""Operator 13 against all products."""

import math
import random

import pytest

from corvella.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, every=100, scale=256):
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        made = ([math.floor(scale * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label)
        held[i] = min(held.get(i, made), made)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in sorted(held):
        if a % every:
            continue
        scored = sorted((-dot(held[a][0], held[i][0]), i) for i in held if i != a)
        for s, p in [(s, i) for s, i in scored if held[i][1] == held[a][1]][:5]:
            found = [(t, i) for t, i in scored if held[i][1] != held[a][1] and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, **limits):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "'x' AS rank", "1 AS key", "2 AS page", "3 AS norm", "4 AS need")
    return sorted(map(tuple, negatives.hard_negatives(df, **limits).collect()))


def vectors(n, dim, seed, lengths=(1.0,), labels=4, step=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.gauss(0.4, 1) for _ in range(dim)]
        length = rng.choice(lengths) / math.hypot(*v)
        out.append((i * step, [x * length for x in v], rng.randrange(labels)))
    return out


@pytest.mark.parametrize(("limits", "lengths"), [({}, (1.0,)), ({"page": 16, "tile": 1, "block": 9}, (0.1, 1.0, 3.0, 9.0))])
def test_equals_all_products(spark, limits, lengths):
    """One page and wave, or several; norms that prune, or do not."""
    rows = vectors(250, 6, 3, lengths)
    got = mined(spark, rows, every=20, **limits)
    assert got == slow(rows, every=20) and got


def test_awkward_rows(spark):
    rows = vectors(200, 4, 8)
    rows += [(None, [1.0] * 4, 1), (300, None, 1), (301, [1.0, None, 0.0, 0.0], 1), (302, [float("nan")] * 4, 1), (303, [float("inf"), 0.0, 0.0, 0.0], 2), (304, [1.0] * 4, None)]
    rows += [rows[0], (100, [5.0, 5.0, 5.0, 5.0], 3), (305, [0.0] * 4, 1), (400, [0.0] * 4, 1), (401, [], 1), (500, [1.0], 2), (-100, [1.0] * 4, 2)]
    assert mined(spark, rows, page=64, tile=1, block=2) == slow(rows)


def test_hot_vector_and_hot_label(spark):
    """A third of the rows are one vector; scores tie, ids decide."""
    rows = vectors(60, 4, 2) + [(1000 + i, [0.5, 0.5, 0.5, 0.5], 1 if i % 4 else 2) for i in range(300)]
    assert mined(spark, rows, page=64, tile=2, block=4) == slow(rows)


def test_only_anchors(spark):
    rows = vectors(60, 5, 6, (1.0, 2.0), step=100)
    assert mined(spark, rows, page=32, tile=1, block=17) == slow(rows)


def test_few_rows(spark):
    for rows in (vectors(2, 3, 1, labels=1), [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2)]):
        assert mined(spark, rows) == slow(rows)


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, None, 1)]) == []


def test_short_norms_are_not_searched(spark):
    """Pages whose longest vector cannot reach the lower limit of any window are pruned before whole rows move."""
    rows = vectors(40, 4, 9, (8.0,)) + [(100 + i, v, label) for i, v, label in vectors(900, 4, 4, (0.01,)) if (100 + i) % 100]
    assert mined(spark, rows, page=64, tile=1) == slow(rows)
