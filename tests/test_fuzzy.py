"""What fuzzy citations compare: no more than a batch with the canonicals before it, and of each text the likeliest first."""

import random

import numpy as np

from corvella.functions import similarity as S
from corvella.operators import citations as C

WORDS = "fern moss rain coast north river stone field survey growth".split()


def made(n, seed):
    r = random.Random(seed)
    return [f"{r.choice(WORDS)} {r.choice(WORDS)} {r.choice(WORDS)} {1990 + r.randrange(3)}" for _ in range(n)]


def test_clusters_by_batches(spark, monkeypatch):
    """The result is that of the order replayed, and no row is made for each pair of similar texts."""
    monkeypatch.setattr(C, "BATCH", 16)
    texts = [*made(200, 1), "", ""]
    seen, inner = [], C.fuzzy_pairs

    def counted(*args):
        pairs = inner(*args)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(C, "fuzzy_pairs", counted)
    uses = {i: i % 5 for i in range(len(texts)) if i % 5}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    counts = spark.createDataFrame(list(uses.items()), "citation_id long, n long")
    got = {r.id: r.canonical for r in C.cluster_first(rows, counts, 0.7).collect()}
    heads, want = [], {}
    near = lambda a, b: a == b or (abs(int(a[-4:]) - int(b[-4:])) <= 1 and S.jaro_winkler(a, b) >= 0.7 if a and b else False)
    for i in sorted(range(len(texts)), key=lambda i: (-uses.get(i, 0), i)):
        # Equal texts go with the first of them.
        same = next((want[j] for j in want if texts[j] == texts[i]), None)
        want[i] = same if same is not None else next((h for h in heads if near(texts[i], texts[h])), i)
        if want[i] == i:
            heads.append(i)
    assert got == want
    distinct = sorted(set(filter(None, texts)))
    every = sum(near(a, b) for k, a in enumerate(distinct) for b in distinct[:k])
    assert sum(seen) < every / 4


def test_best_pairs_compare_few(monkeypatch):
    texts = sorted({*made(300, 2)})
    table, asked, call = S.TextTable(texts), [], S.Comparison.__call__
    monkeypatch.setattr(S.Comparison, "__call__", lambda self, i, j, p: (asked.append(len(i)), call(self, i, j, p))[1])

    def best(pairs):
        out = {}
        for i, j, score in pairs:
            for x, y, s in zip(i.tolist(), j.tolist(), score.tolist()):
                out[x] = max(out.get(x, (0, 0)), (s, -y))
        return out

    other = lambda i, j: np.not_equal(i, j)
    want = best(S.similar_pairs(table, table, 0.8, other))
    every, asked[:] = sum(asked), []
    assert best(S.best_pairs(table, table, 0.8, other)) == want and len(want) > 100
    assert sum(asked) < every / 2
