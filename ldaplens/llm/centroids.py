"""Operator 13: k-means on integer vectors with bounds that are tightened geometrically.

Every vector keeps its cluster, an upper bound on the distance to its centroid and a lower bound on the
distance to any other. When centroids move, a vector whose upper bound stays below the lower one keeps
its cluster unseen; the others are scanned exactly against all centroids.

A lower bound is commonly loosened by the longest drift of any centroid. Here the members of a cluster
are known to lie in a sphere (old centroid, largest upper bound), and one moved centroid can come nearer
to a point of the sphere only by part of its drift. Let m be the middle of the drift from b to b', of
length d. For a point x at angle t from the drift, seen from m, ``|x-b|^2 - |x-b'|^2 = 2 d |x-m| cos t``
and ``|x-b| + |x-b'| >= 2 |x-m|``, so x gets nearer by at most ``d cos t`` where the cosine is positive.
All turns about the line b b' map to one half plane, in which the sphere is a disc: its least angle is
that of its centre less ``asin(radius / |centre - m|)``. If the whole disc lies behind m, every member
gets farther, at least by the disc's nearest offset over the largest sum of distances.

Distances and means are exact integers, bounds are double numbers with a margin; a row of state is
written to shared files after each round, with each task's sums in the same table, so a round is one
pass and its result survives lost executors. The driver sees the centroids only.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldaplens.llm import common

SEED, DIM, CLUSTERS, ROUNDS = 2, 64, 40, 5
SCALE = 256
LARGEST = 1 << 27  # of a scaled component: squared distances then fit 63 bits
EXACT = 1 << 22  # up to here they are exact in double arithmetic too
MARGIN, SHARE = 1e-6, 1 + 1e-9  # by which an upper bound must stay below: rounding of sums of a few doubles

STATE = "vec_id long, x array<long>, cluster int, upper double, lower double, n long, sums array<long>"
SCHEMA = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
_FIELDS = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int64())), ("cluster", pa.int32()), ("upper", pa.float64()),
                     ("lower", pa.float64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c``."""
    if max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, how much nearer at most any other centroid came to a vector of its sphere.

    ``radius`` is the sphere's, about the old centroid; negative for a cluster without members.
    """
    a, b, b2 = old.astype(np.float64)[:, None], old.astype(np.float64)[None], new.astype(np.float64)[None]
    drift = np.sqrt(((b2 - b) ** 2).sum(2))
    middle = (b + b2) / 2
    reach = np.sqrt(((a - middle) ** 2).sum(2))
    r = np.maximum(radius, 0)[:, None] + MARGIN
    with np.errstate(divide="ignore", invalid="ignore"):
        along = ((a - middle) * (b2 - b)).sum(2) / drift
        angle = np.arccos(np.clip(along / reach, -1, 1)) - np.arcsin(np.clip(r / reach, 0, 1))
        nearer = np.where(angle <= 0, drift, drift * np.cos(angle))
        sums = np.sqrt(((a - b) ** 2).sum(2)) + np.sqrt(((a - b2) ** 2).sum(2)) + 2 * r
        nearer = np.where((angle >= np.pi / 2) & (r < reach), 2 * drift * np.minimum(along + r, 0) / sums, nearer)
        nearer = np.where((r >= reach) | (reach == 0), drift, nearer)
    nearer = np.where(drift == 0, 0, nearer)
    np.fill_diagonal(nearer, -np.inf)
    return nearer.max(1) if len(old) > 1 else np.zeros(len(old))


@dataclass(frozen=True)
class Move:
    """What a pass needs to know: the centroids now and how bounds change on the way to them."""

    centroids: np.ndarray
    drift: np.ndarray  # of each centroid
    loosen: np.ndarray  # for each cluster
    apart: np.ndarray  # half the distance to the nearest other centroid

    @staticmethod
    def between(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
        own = np.sqrt(squared(new, new).astype(np.float64))
        np.fill_diagonal(own, np.inf)
        drift = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1))
        return Move(new, drift, loosening(old, new, radius), own.min(1) / 2)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """New clusters and bounds, and how many vectors were scanned; cluster -1 is none yet."""
        cluster, upper, lower = cluster.copy(), upper + self.drift[cluster], lower - self.loosen[cluster]
        bound = np.maximum(lower, self.apart[cluster])
        doubt = np.flatnonzero((cluster < 0) | ~(upper * SHARE + MARGIN < bound))
        known = doubt[cluster[doubt] >= 0]
        if len(known):  # an exact distance to the own centroid may settle it
            upper[known] = np.sqrt(((x[known] - self.centroids[cluster[known]]) ** 2).sum(1).astype(np.float64))
            doubt = doubt[(cluster[doubt] < 0) | ~(upper[doubt] * SHARE + MARGIN < bound[doubt])]
        if len(doubt):
            d = squared(x[doubt], self.centroids)
            cluster[doubt] = best = d.argmin(1)  # the smaller number at equal distance
            upper[doubt] = np.sqrt(d[np.arange(len(d)), best].astype(np.float64))
            if d.shape[1] > 1:
                lower[doubt] = np.sqrt(np.partition(d, 1, 1)[:, 1].astype(np.float64))
            else:
                lower[doubt] = np.inf
        return cluster, upper, lower, len(doubt)


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, DIM)
    if b.num_rows and max(-int(x.min()), int(x.max())) > LARGEST:
        raise ValueError(f"scaled components beyond {LARGEST} have no squared distances in 64 bits")
    return x


def _arrays(b: pa.RecordBatch):
    return (_vectors(b), b.column("cluster").to_numpy(zero_copy_only=False), b.column("upper").to_numpy(zero_copy_only=False),
            b.column("lower").to_numpy(zero_copy_only=False))


def _pass(move: Move):
    """State rows with new clusters, then a row for each cluster: members, sphere and sums of the task."""
    def advance(batches):
        k = len(move.centroids)
        n, sums, radius = np.zeros(k, np.int64), np.zeros((k, DIM), np.int64), np.full(k, -1.0)
        for b in batches:
            x, *bounds = _arrays(b)
            cluster, upper, lower, _ = move.assign(x, *bounds)
            n += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            heads = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            if len(heads):
                sums[cluster[order][heads]] += np.add.reduceat(x[order], heads)
            np.maximum.at(radius, cluster, upper)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower),
                                              pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, _FIELDS.field("sums").type)], schema=_FIELDS)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, _FIELDS.field("x").type), pa.array(np.arange(k), pa.int32()),
                                          pa.array(radius), pa.nulls(k, pa.float64()), pa.array(n), pa.array(sums.tolist(), _FIELDS.field("sums").type)],
                                         schema=_FIELDS)
    return advance


def _last(move: Move):
    """Clusters under the final centroids with exact distances."""
    def advance(batches):
        for b in batches:
            x, *bounds = _arrays(b)
            cluster, *_ = move.assign(x, *bounds)
            own = ((x - move.centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(own)], names=["vec_id", "cluster", "distance"])
    return advance


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the vectors with exactly 64 components, all finite, scaled to integers."""
    usable = (F.size(vec_col) == DIM) & F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda v: F.floor(v.cast("double") * SCALE)).alias("x"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest digests; equal ids by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["x"] for r in kept.orderBy(digest, "x").limit(clusters).collect()], np.int64).reshape(-1, DIM)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every kept vector, written to shared files, and the final centroids."""
    spark = vectors.sparkSession
    common.python_ready(spark)
    kept = kept_vectors(vectors, id_col, vec_col)
    centroids = first_centroids(kept, clusters, seed)
    nowhere = F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<long>").alias("sums")
    state = kept.select("vec_id", "x", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), *nowhere)
    move = Move.between(centroids, centroids, np.full(len(centroids), -1.0)) if len(centroids) else None
    before = None
    for _ in range(rounds if move else 0):
        table = common.written(state.mapInArrow(_pass(move), STATE), "clusters")
        if before:
            common.remove(before)
        before, state = table, table.where("n is null")
        totals = table.where("n is not null")
        shape = {r["cluster"]: (r["n"], r["radius"]) for r in totals.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("upper").alias("radius")).collect()}
        new = centroids.copy()
        for r in totals.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("s")).collect():
            if shape[r["cluster"]][0]:
                new[r["cluster"], r["pos"]] = r["s"] // shape[r["cluster"]][0]
        move = Move.between(centroids, new, np.array([shape[i][1] for i in range(len(new))]))
        centroids = new
    if not move:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    final = common.written(state.mapInArrow(_last(move), "vec_id long, cluster int, distance long"), "clustered")
    if before:
        common.remove(before)
    return final, centroids


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **settings) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Null vectors and vectors of another length or with null or non-finite components are left out. A
    null id stays null and is hashed as no digits; repeated rows are vectors of their own. With fewer
    vectors than clusters each starts one; an empty table gives no rows. Ties go to the smaller number,
    other columns are ignored. A component beyond 2^19 (2^27 scaled) is an error, since squared
    distances would leave 64 bits.
    """
    final, centroids = cluster(vectors, id_col, vec_col, **settings)
    digests = [(i, sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    spark = vectors.sparkSession
    sums = final.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # one row a cluster on the broadcast side
    facts = (sums.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
             .crossJoin(sums.agg(F.sum("cluster_inertia").alias("inertia")).hint("broadcast")))
    return final.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
