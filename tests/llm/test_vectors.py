"""Near-duplicate vectors and clusters against brute force, and on odd tables."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from quernstone.llm import centroids, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, ball long, class string"


@pytest.fixture(scope="module")
def embeddings(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], None, 7, "k") for i, v in rows], schema)


def groups(seed=3, dimension=64):
    """Vectors alone, a large tight group, chains at the threshold, groups with a wide spread, and copies."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    out = [unit(rng.standard_normal(dimension)) for _ in range(150)]
    for size, noise in ((300, 0.1), (40, 0.2), (60, 0.25), (30, 0.16)):
        centre = unit(rng.standard_normal(dimension))
        out += [unit(centre + noise * unit(rng.standard_normal(dimension))) * rng.uniform(0.1, 9) for _ in range(size)]
    a, b = np.eye(dimension)[:2]
    out += [math.cos(t) * a + math.sin(t) * b for t in np.arange(40) * 0.29]  # each links with its neighbours only
    out += [out[5]] * 70 + [out[160]] * 5
    return np.array(out, np.float32)


def brute_links(x, least=0.95):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= least
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            return near.sum(1) - 1, label
        label = new


def test_near_duplicates(spark):
    x = groups(3)
    found = {r.vec_id: r for r in near_vectors.near_duplicates(frame(spark, enumerate(x)), recall=0.9999).collect()}
    links, label = brute_links(x)
    assert len(found) == len(x)
    assert [found[i].n_links for i in range(len(x))] == links.tolist()
    assert [found[i].component_id for i in range(len(x))] == label.tolist()
    assert all(found[i].kept == (label[i] == i) for i in range(len(x)))


def test_near_duplicates_recall(spark):
    """With the production recall no link is invented, and links well above the threshold are found."""
    x = groups(5)
    found = {r.vec_id: r.n_links for r in near_vectors.near_duplicates(frame(spark, enumerate(x))).collect()}
    links, _ = brute_links(x)
    n = np.array([found[i] for i in range(len(x))])
    assert (n <= links).all() and n.sum() >= 0.98 * links.sum()


def test_near_duplicates_blocks(spark, monkeypatch):
    """The same with parts and blocks of a few rows."""
    monkeypatch.setattr(near_vectors, "PART", 4)
    monkeypatch.setattr(near_vectors, "BLOCK", 8)
    monkeypatch.setattr(near_vectors, "ADDED", 16)
    x = groups(6)
    found = {r.vec_id: r for r in near_vectors.near_duplicates(frame(spark, enumerate(x)), recall=0.9999).collect()}
    links, label = brute_links(x)
    assert [found[i].n_links for i in range(len(x))] == links.tolist()
    assert [found[i].component_id for i in range(len(x))] == label.tolist()


def test_near_duplicates_of_the_table(spark, embeddings):
    rows = near_vectors.near_duplicates(embeddings).collect()
    x = {r.vec_id: r.embedding for r in embeddings.collect()}
    links, _ = brute_links(np.array(list(x.values())))
    assert sorted(r.vec_id for r in rows) == sorted(x) and sum(r.n_links for r in rows) == links.sum()


def test_near_duplicates_odd(spark):
    nan, inf, big = float("nan"), float("inf"), 3e38
    rows = [(1, None), (2, []), (3, [0, 0, 0]), (4, [1, None, 0]), (5, [nan, 1, 0]), (6, [inf, 1, 0]), (7, [1, 0, 0]), (8, [2, 0, -0.0]), (None, [big, 0, 0]),
            (9, [1, 0, 0]), (9, [0, 1, 0]), (9, [0, 1, 0]), (10, [1e-40, 0, 0]), (11, [1, 0]), (12, [5, 0]), (None, [0, 0, 1]), (None, None), (13, [3]), (14, [-3]), (15, [1])]
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(frame(spark, rows)).collect()), key=repr)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 14)]
    want = alone + [(7, 4, 7, True), (8, 4, 7, False), (None, 4, 7, False), (9, 4, 7, False), (10, 4, 7, False), (9, 1, 9, True), (9, 1, 9, True), (11, 1, 11, True), (12, 1, 11, False), (None, 0, None, True), (None, 0, None, True), (13, 1, 13, True), (15, 1, 13, False)]
    assert found == sorted(want, key=repr)
    assert near_vectors.near_duplicates(frame(spark, [])).count() == 0
    assert near_vectors.near_duplicates(frame(spark, [(1, [1, 2]), (2, [1, 2.0])], SCHEMA.replace("float", "double"))).where("n_links = 1").count() == 2
    with pytest.raises(ValueError):
        near_vectors.near_duplicates(frame(spark, rows), least=1.0)


def brute_clusters(rows, k=8, rounds=10, dimension=64):
    kept = [(i, [math.floor(Fraction(v) * 1024) for v in x]) for i, x in rows if x is not None and len(x) == dimension and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [x for _, x in first]
    square = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True))
    near = lambda x: min(range(len(c)), key=lambda j: (square(x, c[j]), j))
    for _ in range(rounds):
        held = [[] for _ in c]
        for _, x in kept:
            held[near(x)].append(x)
        c = [[sum(v) // len(h) for v in zip(*h, strict=True)] if h else old for h, old in zip(held, c, strict=True)]
    at = [(i, near(x), x) for i, x in kept]
    d = [(i, a, square(x, c[a])) for i, a, x in at]
    total = {a: sum(z for _, b, z in d if b == a) for _, a, _ in d}
    fit = lambda v: v if v < 1 << 63 else None
    if any(z >= 1 << 63 for _, _, z in d):
        total = {a: None if any(z >= 1 << 63 for _, b, z in d if b == a) else v for a, v in total.items()}
    every = None if None in total.values() else fit(sum(total.values()))
    return sorted(((i, a, fit(z), total[a] and fit(total[a]), every, hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for i, a, z in d), key=repr)


def rows_of(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=repr)


def test_clusters_of_the_table(spark, embeddings, sf):
    x = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    assert rows_of(centroids.op13_centroid_clustering(spark, sf)) == brute_clusters(x)


def test_clusters_odd(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    one = lambda *v: [*v, *[0.0] * (64 - len(v))]
    ties = [(i, one(*[float((i >> k) & 1) * 2 - 1 for k in range(4)])) for i in range(40)]
    rows = [*ties, (1, ties[1][1]), (1, ties[1][1]), (1, ties[2][1]), (None, one(0.5)), (None, None), (50, [1.0]), (51, one(nan)), (52, one(-inf)), (53, [None] * 64), (54, one(-0.0)), (55, [-1e-9] * 64)]
    monkeypatch.setattr(centroids, "CHUNK", 7)
    assert rows_of(centroids.clusters(frame(spark, rows))) == brute_clusters(rows)
    few = [(3, one(1.0)), (4, one(1.0)), (5, one(2.0))]
    assert rows_of(centroids.clusters(frame(spark, few))) == brute_clusters(few)
    assert centroids.clusters(frame(spark, [])).count() == 0 and centroids.clusters(frame(spark, [(1, [1.0])])).count() == 0
    wide = [*ties[:20], (60, one(2.5e5)), (61, one(-(2.0**127))), (62, one(2.0**127, 1.5))]
    assert rows_of(centroids.clusters(frame(spark, wide))) == brute_clusters(wide)
    double = [(1, one(1e308)), (2, one(-1e308)), (3, one(0.3)), *((i, one(i / 7)) for i in range(4, 30))]
    assert rows_of(centroids.clusters(frame(spark, double, SCHEMA.replace("float", "double")))) == brute_clusters(double)


@pytest.mark.parametrize("k", [1, 2, 8, 40])
def test_exponion_is_exact(k):
    """Bounds and balls give what a full scan gives, round by round, with fewer distances."""
    rng = np.random.default_rng(k)
    centres = rng.integers(-900, 900, (12, 8))
    x = centres[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 8))
    c = centroids.Centroids(x[rng.choice(3000, k, replace=False)].tolist())
    state, work = (None, np.zeros(0), np.zeros(0)), 0
    for _ in range(8):
        a, upper, lower, n = centroids.assign(x, c, *state)
        assert (a == centroids._scan_all(x, c)[0]).all()
        state, work = (a, upper, lower), work + n
        c = centroids.Centroids([(x[a == j].sum(0) // max(1, (a == j).sum())).tolist() if (a == j).any() else c.rows[j] for j in range(k)], c)
    assert k < 8 or work < 0.6 * 8 * 3000 * k
