"""Blocks of vectors are sent to bundles of searching blocks, not to each of them."""

import numpy as np

from corvella.operators import neighbours


def test_a_block_is_sent_once_to_a_bundle(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_PIVOT", 20)
    monkeypatch.setattr(neighbours, "BUNDLES", 2)
    sent, inner = [], neighbours.stored

    def kept(rows):
        out = inner(rows)
        if "lefts" in out.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "stored", kept)
    points = np.random.default_rng(3).normal(size=(240, 12))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "id long, vec array<double>")
    blocks = neighbours.Blocks(frame, 10)
    got = {(r.id, r.rank): r.other for r in neighbours.knn(frame, 3, blocks).collect()}
    to = np.round(np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)), neighbours.PLACES)
    np.fill_diagonal(to, np.inf)
    assert got == {(i, k): int(j) for i in range(240) for k, j in enumerate(to[i].argsort()[:3])}
    n = blocks.dealt.select("block").distinct().count()
    assert n > 12 and 0 < sum(sent) <= 2 * n
