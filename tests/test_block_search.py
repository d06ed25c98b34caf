"""The search of blocks for nearest neighbours against brute force."""

import numpy as np
import pandas as pd
import pytest

from corvella.operators import neighbours as N


def block(rng, name, start, n, bound, grid):
    rows = np.round(rng.normal(size=(n, 6)) * grid) / grid
    bounds = np.full(n, bound)
    bounds[::7] = np.nan
    return {"block": name, "ids": np.arange(start, start + n, dtype=np.int64), "rows": rows, "groups": rng.integers(0, 4, n), "cores": np.round(rng.uniform(0, 1.5, n), 3), "bounds": bounds}


def packed(blocks):
    return pd.DataFrame([{c: v if c == "block" else v.tobytes() for c, v in b.items()} for b in blocks])


def brute(a, others, k):
    out = []
    for i, bound in enumerate(a["bounds"]):
        edges = []
        for b in others:
            away = np.round(np.sqrt(((b["rows"] - a["rows"][i]) ** 2).sum(axis=1)), N.PLACES)
            for j, w in enumerate(np.maximum(np.maximum(away, a["cores"][i]), b["cores"])):
                if w <= bound and b["groups"][j] != a["groups"][i]:
                    x, y = a["ids"][i], b["ids"][j]
                    edges.append((w, min(x, y), max(x, y), x, y))
        out += [(x, y, w) for w, _, _, x, y in sorted(edges)[:k]]
    return sorted(out)


@pytest.mark.parametrize("bound,k,grid", [(np.inf, 5, 1000), (np.inf, 3, 1), (2.0, 1, 1000), (1.6, 4, 1), (0.01, 2, 1000)])
def test_search_equals_brute_force(monkeypatch, bound, k, grid):
    """Also with many equal points (a coarse grid) and with tiles that end within blocks."""
    rng = np.random.default_rng(int(k * grid))
    a = block(rng, "a", 0, 90, bound, grid)
    others = [a, *(block(rng, f"b{i}", 1000 * (i + 1), 130, bound, grid) for i in range(3))]
    for rows, wide in ((256, 1024), (32, 48)):
        monkeypatch.setattr(N, "ROWS", rows)
        monkeypatch.setattr(N, "WIDE", wide)
        found = N._search(k, 1e-6)(packed([a]), packed(others))
        assert sorted(zip(found["id"], found["other"], found["weight"])) == brute(a, others, k)


def test_equal_points_are_not_held_all():
    n, k = 3000, 2
    rows = np.ones((n, 4))
    best = N._Best(k, 1e-6, rows[:50], np.arange(50), np.zeros(50), np.full(50, np.inf), rows, np.arange(n) + 100, np.zeros(n))
    i, j = np.nonzero(np.ones((50, 1000), dtype=bool))
    for start in range(0, n, 1000):
        best.add(i, j + start, np.full(len(i), 4.0))
        assert len(best.i) == 50 * k
    assert best.found()["other"].tolist() == [100, 101] * 50
