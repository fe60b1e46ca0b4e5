"""Density clusters, k-means and silhouettes against plain numpy."""

import math

import numpy as np
import pytest

from textmill.operators import density, mining
from textmill.operators.density import NOISE, Density, hdbscan


def plain_hdbscan(x, least, samples):
    """All pairs, one spanning tree, the condensed tree from above, excess of mass."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(samples, n - 1)]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    inside, best, near, edges = np.zeros(n, bool), reach[0].copy(), np.zeros(n, int), []
    inside[0] = True
    for _ in range(n - 1):
        j = np.where(inside, np.inf, best).argmin()
        edges.append((reach[near[j], j], min(near[j], j), max(near[j], j)))
        inside[j] = True
        near[reach[j] < best] = j
        best = np.minimum(best, reach[j])
    head, kids, weight, size, top = {i: i for i in range(2 * n)}, {}, {}, {i: 1 for i in range(n)}, n

    def find(a):
        while head[a] != a:
            a = head[a]
        return a

    for w, a, b in sorted(edges):
        a, b = find(a), find(b)
        head[a] = head[b] = top
        kids[top], weight[top], size[top] = (a, b), w, size[a] + size[b]
        top += 1

    def members(t):
        out, todo = [], [t]
        while todo:
            q = todo.pop()
            if q < n:
                out.append(q)
            else:
                todo += kids[q]
        return out

    clusters, todo = [], [(top - 1, None, 0.0)]
    while todo:
        t, parent, birth = todo.pop()
        me = len(clusters)
        clusters.append({"birth": birth, "points": [], "kids": []})
        if parent is not None:
            clusters[parent]["kids"].append(me)
        while True:
            (a, b), lam = kids[t], 1 / max(weight[t], 1e-12)
            large = [q for q in (a, b) if size[q] >= least]
            gone = members(t) if len(large) != 1 else members(a if large == [b] else b)
            clusters[me]["points"] += [(m, lam) for m in gone]
            if len(large) == 2:
                todo += [(q, me, lam) for q in large]
            if len(large) != 1:
                break
            t = large[0]
    own = [sum(lam - c["birth"] for _, lam in c["points"]) for c in clusters]
    chosen, mass = [False] * len(own), list(own)
    for i in range(len(own) - 1, 0, -1):
        below = sum(mass[k] for k in clusters[i]["kids"])
        chosen[i] = not clusters[i]["kids"] or below <= own[i]
        mass[i] = max(own[i], below)
    labels, todo = np.full(n, NOISE), [(k, NOISE) for k in clusters[0]["kids"]]
    for i, above in todo:
        mark = above if above != NOISE else i if chosen[i] else NOISE
        for m, _ in clusters[i]["points"]:
            labels[m] = mark
        todo += [(k, mark) for k in clusters[i]["kids"]]
    return labels


def _blobs(seed, *parts):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, s, size=(m, 4)) for c, s, m in parts])


def _frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, embedding array<double>")


def _same(a, b):
    pairs = set(zip(list(a), list(b), strict=True))
    return len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs}) and all((p == NOISE) == (q == NOISE) for p, q in pairs)


def _labels(df):
    return np.array([r.cluster for r in df.orderBy("sample_id").collect()])


@pytest.fixture(scope="module")
def blobs(spark):
    x = _blobs(3, (0, 0.3, 150), (4, 0.6, 120), (8, 0.2, 60), (2, 2.5, 120), (9.5, 0.2, 50))
    df = _frame(spark, x).cache()
    order = [r.sample_id for r in density.points_of(df, "sample_id")[1].orderBy("pid").collect()]
    return x, df, order


@pytest.mark.parametrize("least, samples", [(15, 5), (25, None)])
def test_hdbscan_equals_all_pairs(blobs, least, samples):
    x, df, order = blobs
    params = Density(least, samples)
    want = np.empty(len(x), int)
    want[order] = plain_hdbscan(x[order], least, params.samples)
    assert len(set(want)) > 3
    assert _same(want, _labels(hdbscan(df, params)))


def test_hdbscan_in_leaves_and_any_partitioning(blobs):
    x, df, _ = blobs
    whole, cut = _labels(hdbscan(df, Density(15, 5))), Density(15, 5, leaf=128, trees=6)
    parts = _labels(hdbscan(df, cut))
    # of four hundred pairs of points nearly all are told alike by leaves of 128 points
    a, b = np.random.default_rng(0).integers(len(x), size=(2, 400))
    assert np.mean((whole[a] == whole[b]) == (parts[a] == parts[b])) > 0.97
    assert (_labels(hdbscan(df.repartition(7), cut)) == parts).all()


def test_neighbours_in_leaves(blobs):
    x, df, _ = blobs
    params = Density(10, 10, leaf=128, trees=6)
    points, members = density.points_of(df, "sample_id")
    cores = density.core_distances(density.leaves(points, params), params).join(members, "pid").orderBy("sample_id").collect()
    true = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), axis=1)[:, 10]
    got = np.array([r.core for r in cores])
    assert (got >= true - 1e-9).all() and np.mean(got < true * 1.05) > 0.9


def test_hdbscan_contracts_by_joins(spark):
    x = _blobs(5, (0, 0.3, 40), (3, 0.3, 30), (1.5, 1.5, 20))
    df, params = _frame(spark, x), Density(6, 3)
    assert _same(_labels(hdbscan(df, params)), _labels(hdbscan(df, params, driver_edges=5)))


def test_hdbscan_copies_nulls_and_few(spark):
    x = _blobs(9, (0, 0.5, 60), (6, 0.5, 60))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[5].tolist()) for i in range(200)] + [(2000, None)]
    got = {r.sample_id: r.cluster for r in hdbscan(spark.createDataFrame(rows, "sample_id long, embedding array<double>"), Density(10)).collect()}
    assert len(got) == 321 and got[2000] == NOISE
    assert {got[1000 + i] for i in range(200)} == {got[5]} and got[5] != NOISE
    few = _frame(spark, x[:5])
    assert [r.cluster for r in hdbscan(few, Density(10)).collect()] == [NOISE] * 5
    assert hdbscan(few.limit(0), Density(10)).collect() == []


def test_kmeans_finds_blobs_and_comes_to_rest(spark):
    x = _blobs(1, (0, 0.2, 50), (5, 0.2, 80), (10, 0.2, 30), (15, 0.2, 40))
    df = _frame(spark, x)
    got = mining.kmeans(df, 4)
    labels = _labels(got.labels)
    assert got.converged and got.rounds < 100
    assert [len(set(labels[a:b])) for a, b in ((0, 50), (50, 130), (130, 160), (160, 200))] == [1] * 4 and len(set(labels)) == 4
    assert got.cost == pytest.approx(sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in range(4)), rel=1e-6)
    assert not mining.kmeans(df, 30, rounds=1).converged
    again = mining.kmeans(df.repartition(5), 4)
    assert (_labels(again.labels) == labels).all()


def test_kmeans_awkward(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(40, None), (41, [5.0, 5.0])]
    got = mining.kmeans(spark.createDataFrame(rows, "sample_id long, embedding array<double>"), 5)
    assert got.labels.count() == 31 and len(got.centres) == 2 and got.cost == 0
    assert mining.kmeans(got.labels.select("sample_id", mining.F.lit(None).cast("array<double>").alias("embedding")), 3).labels.collect() == []


def _plain_silhouette(x, labels):
    d, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), []
    for i, c in enumerate(labels):
        own = (labels == c) & (np.arange(len(x)) != i)
        if c == NOISE or not own.any():
            continue
        a, b = d[i][own].mean(), min(d[i][labels == o].mean() for o in set(labels) - {c, NOISE})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette(spark):
    x = _blobs(2, (0, 0.8, 60), (2, 0.8, 50), (4, 0.5, 20), (9, 1, 1), (3, 4, 15))
    labels = np.array([0] * 60 + [1] * 50 + [2] * 20 + [3] + [NOISE] * 15)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))] + [(900, None, 1), (901, x[0].tolist(), None)], "sample_id long, embedding array<double>, cluster int")
    assert mining.silhouette(df) == pytest.approx(_plain_silhouette(x, labels), abs=1e-9)
    assert mining.silhouette(df, sample=40) == pytest.approx(_plain_silhouette(x, labels), abs=0.1)
    assert math.isnan(mining.silhouette(df.where("cluster = 1"))) and math.isnan(mining.silhouette(df.limit(0)))


def test_quality_warnings(spark):
    summary = spark.createDataFrame([(0, 60, 0.6, "a / b"), (1, 20, 0.2, "c"), (2, 20, 0.2, "a / b")], "cluster int, size long, share double, label string")
    told = {(r.kind, r.subject, r.value) for r in mining.quality_warnings(summary, 0.1, "hashing_v1").collect()}
    assert told == {("low_silhouette", None, 0.1), ("surface_embedder", "hashing_v1", None), ("dominant_cluster", "0", 0.6), ("shared_label", "a / b", 2.0)}
    assert mining.quality_warnings(summary.where("cluster = 1").withColumn("share", mining.F.lit(0.5)), float("nan"), "semantic").collect() == []


def test_embedding_is_the_sum_of_signed_grams(spark):
    import hashlib

    text = "Abcabc abc é"
    want = np.zeros(256)
    for k in range(len(text) - 3):
        h = int.from_bytes(hashlib.blake2b(text.lower()[k : k + 4].encode(), digest_size=8).digest(), "big")
        want[h % 256] += 1.0 if (h >> 32) & 1 else -1.0
    got = {r.sample_id: r.embedding for r in mining.embed(spark.createDataFrame([(1, text), (2, None), (3, "abc")], "sample_id long, text string")).collect()}
    assert np.allclose(got[1], want / np.linalg.norm(want)) and not any(got[2]) and not any(got[3])
