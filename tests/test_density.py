"""Nearest neighbours, density clustering and the projection against slow versions on small sets of points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.operators import density, neighbours, places, projection

SCHEMA = "id long, vec array<double>"


def frame(spark, points, ids=None, parts=4):
    return spark.createDataFrame([(int(i), [float(x) for x in p]) for i, p in zip(ids if ids is not None else range(len(points)), points, strict=True)], SCHEMA).repartition(parts)


def distances(points):
    return np.round(np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)), neighbours.PLACES)


def blobs(n, dim, seed, centres=4, noise=0.2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 6, (centres, dim))
    near = middle[rng.integers(0, centres, int(n * (1 - noise)))] + rng.normal(0, 0.5, (int(n * (1 - noise)), dim))
    return np.concatenate([near, rng.uniform(-12, 12, (n - len(near), dim))])


def nearest(points, k):
    d = distances(points)
    return {i: sorted((d[i, j], min(i, j), max(i, j)) for j in range(len(points)) if j != i)[:k] for i in range(len(points))}


@pytest.mark.parametrize(("block", "k"), [(1024, 5), (16, 40)])
def test_neighbours(spark, block, k, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_PIVOT", 30)
    points = blobs(150, 5, 1)
    points[40:60] = points[40]
    got = neighbours.knn(frame(spark, points), k, neighbours.Blocks(frame(spark, points), block)).collect()
    want = nearest(points, k)
    for i in range(len(points)):
        mine = sorted((r for r in got if r.id == i), key=lambda r: r["rank"])
        assert [(r.weight, min(i, r.other), max(i, r.other)) for r in mine] == want[i]


def test_few_neighbours(spark):
    assert neighbours.knn(frame(spark, []), 3).collect() == []
    assert neighbours.knn(frame(spark, [(1.0, 2.0)]), 3).collect() == []
    assert len(neighbours.knn(frame(spark, [(1.0, 2.0), (1.0, 2.0)]), 3).collect()) == 2


def spanning(points, min_samples=1):
    """Kruskal over all pairs."""
    d = distances(points)
    core = np.sort(d + np.where(np.eye(len(d)) > 0, np.inf, 0), axis=1)[:, min_samples - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    out = []
    for w, i, j in sorted((reach[i, j], i, j) for i in range(len(points)) for j in range(i + 1, len(points))):
        if find(i) != find(j):
            root[find(i)] = find(j)
            out.append((w, i, j))
    return out


def slow_clusters(points, least=5, min_samples=1):
    """The textbook way: a dendrogram, condensed from the root, the most stable clusters taken."""
    n = len(points)
    if n < 2:
        return [-1] * n
    top = {i: i for i in range(n)}
    member, kids, weight = {i: [i] for i in range(n)}, {}, {}
    for m, (w, i, j) in enumerate(spanning(points, min_samples)):
        a, b = top[i], top[j]
        member[n + m], kids[n + m], weight[n + m] = member[a] + member[b], (a, b), max(w, density.LEAST_WEIGHT)
        for x in member[n + m]:
            top[x] = n + m
    root = max(member)
    if n < least:
        return [-1] * n
    stable, parts = {}, {}

    def grow(start, born):
        node, mass = start, 0.0
        while True:
            big = [k for k in kids.get(node, ()) if len(member[k]) >= least]
            lam = 1 / weight[node]
            if len(big) == 1:
                mass += (len(member[node]) - len(member[big[0]])) * lam
                node = big[0]
                continue
            mass += len(member[node]) * lam
            parts[start] = big if len(big) == 2 else []
            stable[start] = mass - len(member[start]) * born
            for k in parts[start]:
                grow(k, lam)
            return

    grow(root, 0.0)

    def best(c):
        under = [best(k) for k in parts[c]]
        inner = sum(s for s, _ in under)
        return (stable[c], [c]) if not under or stable[c] >= inner else (inner, [x for _, chosen in under for x in chosen])

    chosen = [c for k in parts[root] for c in best(k)[1]]
    chosen.sort(key=lambda c: (-len(member[c]), min(member[c])))
    label = [-1] * n
    for number, c in enumerate(chosen):
        for x in member[c]:
            label[x] = number
    return label


@pytest.mark.parametrize(("n", "dim", "min_samples", "least"), [(500, 8, 1, 5)])
def test_clusters_equal_slow_version(spark, n, dim, min_samples, least):
    points = blobs(n, dim, n)
    points[: n // 10] = points[0]
    want = slow_clusters(points, least, min_samples)
    got = {r.id: r for r in density.clusters(frame(spark, points), least, min_samples).collect()}
    assert [got[i].cluster for i in range(n)] == want
    assert -1 in want and max(want) > 0
    assert all((r.strength == 0) == (r.cluster == -1) and 0 <= r.strength <= 1 for r in got.values())


def slow_chosen(rows):
    """From the leaves up, then from the root down, one cluster at a time."""
    stable, parent, parts, order = {r[0]: r[3] for r in rows}, {r[0]: r[1] for r in rows}, {}, [None]
    for of, up in parent.items():
        parts.setdefault(up, []).append(of)
    for x in order:
        order += parts.get(x, [])
    score, kept, label = {}, {}, {None: None}
    for x in reversed(order[1:]):
        inner = sum(score[k] for k in parts[x]) if x in parts else stable[x]
        kept[x], score[x] = stable[x] >= inner, max(stable[x], inner)
    for x in order[1:]:
        up = parent[x]
        label[x] = None if up is None else label[up] if label[up] is not None else x if kept[x] else None
    return {x: label[x] for x in order[1:]}


@pytest.mark.parametrize("nested", ["chain", "bush"])
def test_chosen_clusters_of_deep_nesting(spark, nested, monkeypatch):
    """Clusters nested 200 deep take few rounds, and the same ones are chosen as one by one."""
    rng = np.random.default_rng(7)
    rows, leaves = [(0, None, 1, 3.0)], [0]
    for _ in range(200):
        up = leaves.pop(-1 if nested == "chain" else -rng.integers(1, min(3, len(leaves)) + 1))
        for _ in range(2):
            rows.append((len(rows), up, 1, float(rng.integers(1, 8 if nested == "bush" else 200))))
            leaves.append(len(rows) - 1)
    written, stored = [], density.stored
    monkeypatch.setattr(density, "stored", lambda x: written.append(1) or stored(x))
    got = density._chosen(spark.createDataFrame(rows, "of long, parent long, size long, stability double").repartition(3))
    assert {r.of: r.label for r in got.collect()} == slow_chosen(rows)
    assert len(written) < 40 and len(set(slow_chosen(rows).values())) > 20


def test_no_search_where_lists_are_sure(spark, monkeypatch):
    """A large group and lone points far from it: what leaves the group stands in the lone points' lists, so nothing is searched."""
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 1, (60, 3)), 30 * np.array([(1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, 0, 0)])])
    searched, nearest_edges = [], density.nearest
    monkeypatch.setattr(density, "nearest", lambda *a: searched.append(1) or nearest_edges(*a))
    tree = density.SpanningTree(frame(spark, points), k=8)
    assert sorted((r.w, r.lo, r.hi) for r in tree.edges().collect()) == sorted(spanning(points)) and not searched


def test_tree_is_exact_where_lists_are_short(spark, monkeypatch):
    """Two far groups larger than the neighbour lists: their bridge is found by search."""
    monkeypatch.setattr(neighbours, "PER_PIVOT", 20)
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(40, 1, (60, 3)), rng.normal(-40, 1, (3, 3))])
    tree = density.SpanningTree(frame(spark, points), k=4)
    assert sorted((r.w, r.lo, r.hi) for r in tree.edges().collect()) == sorted(spanning(points))
    assert len(tree.rounds) <= np.ceil(np.log2(len(points)))


def test_dendrogram_sizes(spark):
    points = blobs(40, 2, 5)
    nodes, leaves = density.dendrogram(density.SpanningTree(frame(spark, points)))
    rows = {(r.w, r.lo, r.hi): r for r in nodes.collect()}
    member = {}
    for w, i, j in sorted(spanning(points)):
        joined = member.get(i, {i}) | member.get(j, {j})
        for x in joined:
            member[x] = joined
        assert rows[w, i, j]["size"] == len(joined)
    assert len(rows) == 39 and sum(r.up is None for r in rows.values()) == 1 and leaves.count() == 40


def test_few_points(spark):
    assert density.clusters(frame(spark, [])).collect() == []
    for n in (1, 7):
        got = density.clusters(frame(spark, np.arange(2 * n).reshape(n, 2))).collect()
        assert [r.cluster for r in got] == [-1] * n


def test_roots_and_sums(spark):
    links = spark.createDataFrame([(i, max(0, i - 1)) for i in range(40)] + [(100, 100), (101, 100)], "node long, to long")
    assert {r.node: r.root for r in places.roots(links).collect()} == dict.fromkeys(range(40), 0) | {100: 100, 101: 100}
    rows = spark.createDataFrame([(k, i, i) for k in "ab" for i in range(9000)], "k string, rank long, a long")
    got = places.summed(rows, ["k"], "a").filter("k = 'a'").collect()
    assert all(r.sum == r["rank"] * (r["rank"] + 1) // 2 for r in got)


def preserved(high, low, k=10):
    a, b = (np.argsort(((p[:, None] - p[None]) ** 2).sum(axis=2) + np.where(np.eye(len(p)) > 0, np.inf, 0), axis=1)[:, :k] for p in (high, low))
    return np.mean([len(set(x) & set(y)) / k for x, y in zip(a, b, strict=True)])


def test_plane(spark):
    points = blobs(240, 10, 2, centres=6, noise=0)
    points /= np.linalg.norm(points, axis=1)[:, None]
    flat = np.array([(r.x, r.y) for r in projection.plane(frame(spark, points), rounds=15, start_steps=8).orderBy("id").collect()])
    centred = points - points.mean(axis=0)
    pca = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert np.isfinite(flat).all() and preserved(points, flat) > preserved(points, pca) + 0.03


def test_plane_in_another_layout(spark):
    points = blobs(50, 4, 2)
    one = projection.plane(frame(spark, points), rounds=2, start_steps=2).orderBy("id").collect()
    assert one == projection.plane(frame(spark, points, parts=1).repartition(3, F.col("id") % 5), rounds=2, start_steps=2).orderBy("id").collect()


def test_plane_of_few_points(spark):
    assert projection.plane(frame(spark, [])).collect() == []
    assert projection.plane(frame(spark, [(1.0, 0.0)])).collect()[0][1:] == (0.0, 0.0)
    assert len(projection.plane(frame(spark, [(1.0, 0.0), (0.0, 0.0), (0.0, 1.0)]), rounds=3).collect()) == 3
