"""Operator 13: clusters of vectors by ball k-means, exact, over whole numbers.

Each cluster is a ball: its centroid, and a radius that no member exceeds. After the centroids have
moved, a member can only have come nearer to a centroid that is at most twice its own distance away,
so a ball has as neighbours the centroids within twice its radius. Members whose doubled distance is
below that to the nearest neighbour are the stable core and are not compared. The others lie in
annuli between the neighbours, which are sorted by distance: a member is compared with the
neighbours up to its annulus only. Results are those of Lloyd's algorithm, ties included.

Vectors are quantised by Spark and written once for each round with their cluster. Rounds are map
jobs without a shuffle; what comes to the driver is k rows of sums and radii, so equal vectors,
however many, meet in no task. Centroids (k times the number of components) go to the tasks.

Kept are vectors with exactly ``size`` components, none null, NaN or infinite; others have no row in
the result. A null id hashes like an empty one. Rows that are equal in all columns each have a row.
Ties: the smaller cluster. With fewer vectors than ``k`` there are as many clusters as vectors; an
empty table gives no rows. Components beyond 2**21 have distances beyond 64 bits and raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import discard, saved, table

#: Centroids, rounds, components of a vector, steps in a unit, and the largest component.
CLUSTERS, ROUNDS, SIZE, STEPS, LARGEST = 16, 3, 64, 64, 2.0**21

STATE = "id {id}, q array<int>, cluster int, distance bigint"


def quantized(df: DataFrame, id_col: str, vec_col: str, size: int = SIZE) -> DataFrame:
    """(id, q): the kept vectors as whole numbers floor(STEPS * x)."""
    x = F.col(f"`{vec_col}`").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = df.select(F.col(f"`{id_col}`").alias("id"), x.alias("x")).where(F.size(x) == size).where(fine)
    small = F.forall("x", lambda v: F.abs(v) <= LARGEST)
    return kept.select("id", F.when(small, F.transform("x", lambda v: F.floor(v * STEPS).cast("int"))).otherwise(F.raise_error(F.lit("a component is too large for distances of 64 bits"))).alias("q"))


def first_centroids(vectors: DataFrame, k: int) -> list[list[int]]:
    """The k vectors of the smallest hashes of their ids; of equal ids the smaller vector."""
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r.q) for r in vectors.select("q", order.alias("order")).orderBy("order", "q").limit(k).collect()]


def apart(a: list[int], b: list[int]) -> int:
    """The squared distance of two centroids."""
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def neighbours(centroids: list[list[int]], radii: list[int]) -> list[list[tuple[int, int]]]:
    """For each ball the (squared distance, number) of the centroids within twice its radius, nearest first; -1 is the radius of an empty ball."""
    out = []
    for i, c in enumerate(centroids):
        far = ((apart(c, other), j) for j, other in enumerate(centroids) if j != i)
        out.append(sorted((d, j) for d, j in far if radii[i] >= 0 and d <= 4 * radii[i] ** 2))
    return out


def moved_radius(longest: int, shift: int) -> int:
    """A whole number that no member's distance to the moved centroid exceeds, from the squared old radius and shift."""
    return isqrt(longest) + 1 + isqrt(shift) + 1


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) by comparing with all centroids, for the first assignment."""
    best = np.zeros(len(v), dtype=np.int32)
    least = ((v - centroids[0]) ** 2).sum(axis=1)
    for j in range(1, len(centroids)):
        d = ((v - centroids[j]) ** 2).sum(axis=1)
        nearer = d < least  # of equals the smaller number stays
        best[nearer], least[nearer] = j, d[nearer]
    return best, least


def within_balls(v: np.ndarray, old: np.ndarray, centroids: np.ndarray, near: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of vectors with clusters ``old``, comparing with relevant neighbours only."""
    best, least = old.copy(), ((v - centroids[old]) ** 2).sum(axis=1)
    for i in np.unique(old):
        if not near[i]:
            continue
        members = np.flatnonzero(old == i)
        own = least[members].copy()  # all the core fails the first test below
        for d, j in near[i]:
            ring = 4 * own >= d  # its annulus reaches this neighbour; equality may be a tie
            members, own = members[ring], own[ring]
            if not len(members):
                break
            to_j = ((v[members] - centroids[j]) ** 2).sum(axis=1)
            nearer = (to_j < least[members]) | ((to_j == least[members]) & (j < best[members]))
            best[members[nearer]], least[members[nearer]] = j, to_j[nearer]
    return best, least


def assigned(state: DataFrame, centroids: list[list[int]], near: list[list[tuple[int, int]]] | None = None) -> DataFrame:
    """(id, q, cluster, distance): vectors with their nearest centroid; with ``near`` they have one already."""
    c, size = np.array(centroids, dtype=np.int64), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, size)
            cluster, distance = nearest(v, c) if near is None else within_balls(v, batch.column(2).to_numpy(), c, near)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "q", "cluster", "distance"])

    return state.mapInArrow(run, STATE.format(id=state.schema["id"].dataType.simpleString()))


def moved(state: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """The new centroids and the radii around them; a cluster without members keeps its centroid and is empty."""
    sums = [F.sum(F.get("q", i)).alias(f"s{i}") for i in range(len(centroids[0]))]
    found = {r.cluster: r for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("longest"), *sums).collect()}
    new, radii = [], []
    for j, c in enumerate(centroids):
        r = found.get(j)
        new.append([r[f"s{i}"] // r.n for i in range(len(c))] if r else c)
        radii.append(moved_radius(r.longest, apart(c, new[-1])) if r else -1)
    return new, radii


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> tuple[DataFrame, list[list[int]]]:
    """(id, q, cluster, distance) of all kept vectors after ``rounds`` moves, and the final centroids."""
    vectors = saved(quantized(df, id_col, vec_col, size))
    centroids = first_centroids(vectors, k)
    if not centroids:
        return vectors.selectExpr("id", "q", "cast(null as int) cluster", "cast(null as bigint) distance"), []
    state = saved(assigned(vectors, centroids))
    discard(vectors)
    for _ in range(rounds):
        centroids, radii = moved(state, centroids)
        old, state = state, saved(assigned(state, centroids, neighbours(centroids, radii)))
        discard(old)
    return state, centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all embeddings, with the inertia of each and of all."""
    state, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows, as are the digests
    total = sums.agg(F.sum("cluster_inertia")).first()[0] or 0
    known = spark.createDataFrame([(j, digest(c)) for j, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    both = F.broadcast(sums.join(F.broadcast(known), "cluster"))
    return state.join(both, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(total).cast("bigint").alias("inertia"), "centroid_sha256")


def kmeans_oracle(k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> str:
    """The same clusters in DuckDB, by comparing all vectors with all centroids."""
    fine = f"len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({STEPS} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {fine})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS j, q AS c FROM v QUALIFY j < {k})",
    ]
    for t in range(rounds + 1):
        distance = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (v.q[i] - c{t}.c[i]) * (v.q[i] - c{t}.c[i])))::BIGINT"
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, min(struct_pack(d := {distance}, j := j)) AS n FROM v, c{t} GROUP BY r)")
        if t < rounds:
            parts.append(f"s{t} AS (SELECT n.j AS j, i, sum(q[i])::BIGINT AS s, count(*) AS m FROM a{t} JOIN v USING (r), range(1, {size + 1}) x(i) GROUP BY 1, 2)")
            parts.append(f"m{t} AS (SELECT j, list((s - ((s % m) + m) % m) // m ORDER BY i) AS c FROM s{t} GROUP BY j)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (j))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, n.j::INT AS cluster, n.d AS distance, (sum(n.d) OVER (PARTITION BY n.j))::BIGINT AS cluster_inertia, (sum(n.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} ON n.j = c{rounds}.j"""
