import math
import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from ldaplens.llm.centroids import Move, cluster_vectors, loosening, squared


def brute(rows, clusters=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:clusters]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((dist(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        c = [[sum(col) // len(members[j]) for col in zip(*members[j])] if members[j] else m for j, m in enumerate(c)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, j, d in found:
        sums[j] += d
    return [(i, j, d, sums[j], sum(sums.values()), sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found]


def vectors(rnd, n, spread=1.0, centres=9):
    mids = [[rnd.gauss(0, 3) for _ in range(64)] for _ in range(centres)]
    return [(i, [m + rnd.gauss(0, spread) for m in rnd.choice(mids)]) for i in range(n)]


def check(spark, rows, **kw):
    df = spark.createDataFrame([(1, v, "c", i) for i, v in rows], "cluster int, embedding array<double>, x string, vec_id long").repartition(3)
    got = sorted(map(tuple, cluster_vectors(df).collect()), key=str)
    assert got == sorted(brute(rows, **kw), key=str)


def test_odd_rows(spark):
    rnd = random.Random(1)
    rows = vectors(rnd, 150)
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [1.0] * 63 + [None]), (205, [float("nan")] * 64),
             (206, [float("inf")] + [0.0] * 63), (None, [0.5] * 64), (3, rows[3][1]), (3, rows[3][1]), (7, [0.0] * 64), (208, [0.0] * 64), (209, [-0.001] * 64)]
    check(spark, rows)


def test_copies_and_empty_clusters(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(100)]  # 40 first centroids, three places: ties, empty clusters
    check(spark, rows)


def test_fewer_vectors_than_clusters_and_none(spark):
    check(spark, vectors(random.Random(2), 5))
    check(spark, vectors(random.Random(2), 1))
    assert cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_large_components(spark):
    check(spark, [(i, [x * 20_000 for x in v]) for i, v in vectors(random.Random(4), 60)])
    far = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no squared distances"):
        cluster_vectors(far).collect()


def test_bounds_hold_and_save_scans():
    rnd = np.random.default_rng(5)
    mids = rnd.integers(-900, 900, (12, 64))
    x = (mids[rnd.integers(0, 12, 4000)] + rnd.integers(-60, 60, (4000, 64))).astype(np.int64)
    c = x[:12].copy()
    move = Move.between(c, c, np.full(12, -1.0))
    cluster, upper, lower = np.full(4000, -1), np.zeros(4000), np.zeros(4000)
    scanned = []
    for _ in range(8):
        cluster, upper, lower, n = move.assign(x, cluster, upper, lower)
        scanned.append(n)
        d = squared(x, c)
        assert (cluster == d.argmin(1)).all()
        own = np.sqrt(d[np.arange(4000), cluster])
        d[np.arange(4000), cluster] = np.iinfo(np.int64).max
        assert (own <= upper + 1e-5).all() and (np.sqrt(d.min(1)) >= lower - 1e-5).all()
        radius = np.array([upper[cluster == j].max(initial=-1) for j in range(12)])
        new = np.array([x[cluster == j].sum(0) // max((cluster == j).sum(), 1) if (cluster == j).any() else c[j] for j in range(12)])
        move, c = Move.between(c, new, radius), new
    assert scanned[0] == 4000 and scanned[-1] < 400


def test_loosening_is_a_bound_below_the_full_drift():
    rnd = np.random.default_rng(6)
    saved = 0
    for _ in range(60):
        old = rnd.integers(-300, 300, (5, 64))
        new = old + rnd.integers(-40, 40, (5, 64))
        radius = rnd.uniform(0, 900, 5)
        got = loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(5):
            others = [j for j in range(5) if j != i]
            assert got[i] <= drift[others].max() + 1e-6
            saved += got[i] < 0.9 * drift[others].max()
            way = rnd.normal(size=(300, 64))
            way = np.concatenate([way, *[(s * (new[j] - old[j]) + s2 * way[:20] * .1) for j in others for s in (1, -1) for s2 in (0, 1)]])
            p = old[i] + way / np.maximum(np.sqrt((way ** 2).sum(1)), 1e-9)[:, None] * radius[i] * rnd.uniform(0, 1, (len(way), 1)) ** .1
            nearer = [np.sqrt(((p - old[j]) ** 2).sum(1)) - np.sqrt(((p - new[j]) ** 2).sum(1)) for j in others]
            assert max(n.max() for n in nearer) <= got[i] + 1e-6
    assert saved > 50
