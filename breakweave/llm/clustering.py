"""Exact k-means with Yinyang bounds.

Centroids are clustered into groups once, where they start. A vector carries an upper bound of the distance to its centroid and a lower bound a group, of the distances to
the group's other centroids. When centroids move, bounds move by as much; a vector whose upper bound stays below all lower ones keeps its centroid unseen (global filter), others look only at
the groups whose bound is not above (group filter) and there only at the centroids that the bound less their own move does not exclude (local filter), exactly and in whole numbers.
Bounds are doubles with a margin, so that rounding never hides a nearer or tied centroid: the result is that of comparing every pair.

A round is one pass over a written table of vectors, centroids and bounds, which writes the next one and, beside the vectors, each task's sums: at most k rows a task. Vectors are
never shuffled, so copies of one vector are no hot spot; the driver holds k centroids.

Vectors of other lengths, with a null or non-finite component, or null, are left out, and so are those with a component of 2^19 or more, whose squared distances need not fit. Rows that
share an id are rows of their own; rows without an id take part, but never start a centroid. Ties: the smaller centroid number; equal hashes at the start: the smaller vector.
Fewer vectors than centroids: as many centroids as vectors (or with an id). No vectors, or none with an id: no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

DIMENSIONS, CENTROIDS, ROUNDS, GROUP, SCALE, LIMIT = 64, 40, 5, 10, 256, 2**27
#: Ids are text, which pandas keeps as it is. kind 0: a vector; kind 1: a task's sums for a centroid (at), of vectors (sums, size) or distances (distance).
SCHEMA = "kind int, vec_id string, vector array<int>, at int, upper double, lower array<double>, distance long, size long, sums array<long>, scanned long"
EPS = 1e-9


def whole(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, limit: int = LIMIT) -> DataFrame:
    """(vec_id, vector): kept vectors in whole numbers; ids as text."""
    x = embeddings["embedding"].cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < limit))
    rows = embeddings.where((F.size(x) == dimensions) & finite)
    return rows.select(embeddings["vec_id"].cast("long").cast("string").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("vector"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors with the smallest hash of their id."""
    named = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit("2:"), "vec_id"), 256).alias("h"), "vector")
    return np.array([r.vector for r in named.orderBy("h", "vector").limit(k).collect()], dtype=np.int64)


def groups_of(centroids: np.ndarray, most: int = GROUP) -> np.ndarray:
    """A group number for each centroid: a few rounds of k-means over the centroids, from ones spread evenly over their numbers."""
    t = max(1, -(-len(centroids) // most))
    c = centroids.astype(float)
    middle = c[np.linspace(0, len(c) - 1, t).astype(int)]
    for _ in range(5):
        of = ((c[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        middle = np.array([c[of == g].mean(axis=0) if (of == g).any() else middle[g] for g in range(t)])
    return np.unique(of, return_inverse=True)[1]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to one centroid each, or to one for all."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def start(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, the distance squared, and bounds, from all pairs."""
    d2 = np.stack([squared(x, row) for row in c], axis=1)
    at = d2.argmin(axis=1)
    rows, best = np.arange(len(x)), d2.min(axis=1)
    rest = np.sqrt(d2.astype(float))
    rest[rows, at] = np.inf
    lower = np.stack([rest[:, group == g].min(axis=1) for g in range(group.max() + 1)], axis=1)
    return at, best, np.sqrt(best.astype(float)) * (1 + EPS), lower * (1 - EPS)


def step(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, moved: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Assignments and bounds after the centroids moved to c, and how many distances it took."""
    at, upper, before = at.copy(), upper + moved[at], lower
    lower = before - np.array([moved[group == g].max() for g in range(lower.shape[1])])[None]
    rows = np.flatnonzero(upper >= lower.min(axis=1))
    exact = np.zeros(len(x), dtype=np.int64)
    exact[rows] = squared(x[rows], c[at[rows]])
    upper[rows] = np.sqrt(exact[rows].astype(float)) * (1 + EPS)
    n, rows = len(rows), rows[upper[rows] >= lower[rows].min(axis=1)]
    if not len(rows):
        return at, upper, lower, n
    old, best, best2 = at[rows].copy(), at[rows].copy(), exact[rows].copy()
    new = np.full((len(rows), lower.shape[1]), np.inf)
    own2 = exact[rows]
    found = []
    for g in range(lower.shape[1]):
        ask = upper[rows] >= lower[rows, g]
        new[~ask, g] = lower[rows[~ask], g]
        for j in np.flatnonzero(group == g):
            bound = before[rows, g] - moved[j]
            scan = ask & (old != j) & (bound <= np.sqrt(best2.astype(float)) * (1 + EPS))
            unseen = ask & (old != j) & ~scan
            new[unseen, g] = np.minimum(new[unseen, g], bound[unseen])
            hit = np.flatnonzero(scan)
            d2 = squared(x[rows[hit]], c[j])
            n += len(hit)
            found.append((g, j, hit, d2))
            nearer = (d2 < best2[hit]) | ((d2 == best2[hit]) & (j < best[hit]))
            best[hit[nearer]], best2[hit[nearer]] = j, d2[nearer]
    for g, j, hit, d2 in found:
        others = best[hit] != j
        new[hit[others], g] = np.minimum(new[hit[others], g], np.sqrt(d2[others].astype(float)) * (1 - EPS))
    left = np.flatnonzero(best != old)
    g = group[old[left]]
    new[left, g] = np.minimum(new[left, g], np.sqrt(own2[left].astype(float)) * (1 - EPS))
    at[rows], lower[rows] = best, new
    upper[rows] = np.sqrt(best2.astype(float)) * (1 + EPS)
    return at, upper, lower, n


class Sums:
    """What a task has seen of each centroid: vectors, their sum, their distances, and the distances it took."""

    def __init__(self, k: int):
        self.size, self.sums, self.distance, self.scanned = np.zeros(k, dtype=np.int64), np.zeros((k, DIMENSIONS), dtype=np.int64), np.zeros(k, dtype=np.int64), 0

    def add(self, x: np.ndarray, at: np.ndarray, distance: np.ndarray | None) -> None:
        self.size += np.bincount(at, minlength=len(self.size))
        for j in np.unique(at):
            self.sums[j] += x[at == j].sum(axis=0)
            if distance is not None:
                self.distance[j] += distance[at == j].sum()

    def rows(self) -> pd.DataFrame:
        some = np.flatnonzero(self.size)
        scanned = np.where(np.arange(len(some)) == 0, self.scanned, 0)
        return pd.DataFrame({
            "kind": 1, "vec_id": None, "vector": None, "at": some, "upper": 0.0, "lower": None, "distance": self.distance[some], "size": self.size[some],
            "sums": list(self.sums[some]), "scanned": scanned,
        })


def assigned(rows: DataFrame, c: np.ndarray, moved: np.ndarray | None, group: np.ndarray, last: bool) -> DataFrame:
    """One pass: SCHEMA, of vectors with their centroid and bounds, and of sums. moved: how far each centroid moved since rows were assigned; none: they never were."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Sums(len(c))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vector"].tolist()).astype(np.int64)
            if moved is None:
                at, distance, upper, lower = start(x, c, group)
                seen.scanned += len(x) * len(c)
            else:
                at, upper, lower, n = step(x, pdf["at"].to_numpy(), pdf["upper"].to_numpy(), np.stack(pdf["lower"].tolist()), c, moved, group)
                seen.scanned += n
                distance = None
            if last:
                distance = squared(x, c[at])
            seen.add(x, at, distance if last else None)
            yield pd.DataFrame({
                "kind": 0, "vec_id": pdf["vec_id"], "vector": None if last else pdf["vector"], "at": at, "upper": upper, "lower": None if last else list(lower), "distance": distance if last else 0, "size": 1, "sums": None, "scanned": 0,
            })
        yield seen.rows()

    return rows.mapInPandas(run, SCHEMA)


def gathered(table: DataFrame) -> list:
    """The tasks' sums, a row a centroid."""
    each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIMENSIONS)]
    return table.where("kind = 1").groupBy("at").agg(F.sum("size").alias("size"), F.sum("distance").alias("distance"), F.sum("scanned").alias("scanned"), *each).collect()


class Clusters:
    """rows: (vec_id, cluster, distance); a centroid and an inertia a cluster; distances counted in each round."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, inertia: dict[int, int], scanned: list[int]):
        self.rows, self.centroids, self.inertia, self.scanned = rows, centroids, inertia, scanned


def cluster(spark: SparkSession, embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> Clusters | None:
    """k-means from the first centroids: rounds times assign and move, then assign once more. None without centroids."""
    scratch = Scratch(spark, "clusters")
    vectors = scratch.save(whole(embeddings), "vectors")
    c = first_centroids(vectors, k)
    if not len(c):
        return None
    group, moved, rows, scanned = groups_of(c), None, vectors, []
    for i in range(rounds + 1):
        table = scratch.save(assigned(rows, c, moved, group, i == rounds), f"round{i}")
        sums = gathered(table)
        scanned.append(sum(r.scanned for r in sums))
        if i == rounds:
            inertia = {r["at"]: r.distance for r in sums}
            break
        new = c.copy()
        for r in sums:
            new[r["at"]] = [r[f"s{d}"] // r.size for d in range(DIMENSIONS)]
        moved = np.sqrt(squared(new, c).astype(float)) * (1 + EPS)
        c, rows = new, table.where("kind = 0").select("vec_id", "vector", "at", "upper", "lower")
    return Clusters(table.where("kind = 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("at").alias("cluster"), "distance"), c, inertia, scanned)


def digests(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    found = cluster(spark, embeddings)
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    total = sum(found.inertia.values())
    facts = [(int(j), int(d), int(total), sha256(",".join(str(v) for v in found.centroids[j].tolist()).encode()).hexdigest()) for j, d in found.inertia.items()]
    rows = found.rows.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql() -> str:
    """Each round: the least distance and number of every vector, then the means, rounded down; an empty centroid stays."""
    near = "select vec_id, any_value(x) as x, min(list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) * 64 + k)::bigint as best from (select v.vec_id, v.x, c.x as y, c.k from v, c{i} c) group by vec_id"
    mean = """select k, case when m.x is null then c.x else m.x end as x from c{i} c left join (
 select k, list((s - ((s % n) + n) % n) // n order by i) as x from (select best % 64 as k, i, sum(x[i])::bigint as s, count(*) as n from a{i}, range(1, 65) r(i) group by best % 64, i) group by k) m using (k)"""
    parts = []
    for i in range(ROUNDS):
        parts += [f"a{i} as materialized ({near.format(i=i)})", f"c{i + 1} as materialized ({mean.format(i=i)})"]
    return ", ".join([*parts, f"a{ROUNDS} as materialized ({near.format(i=ROUNDS)})"])


SQL = f"""with v as materialized (select vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as x from embeddings
 where len(embedding) = 64 and len(list_filter(embedding, lambda e: isfinite(e))) = 64
), c0 as materialized (select row_number() over (order by h) - 1 as k, x from (select sha256('2:' || vec_id) as h, x from v order by h limit {CENTROIDS})), {_rounds_sql()},
out as (select vec_id, (best % 64)::int as cluster, best // 64 as distance from a{ROUNDS})
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from out join c{ROUNDS} c on c.k = out.cluster"""
