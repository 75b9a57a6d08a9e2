"""Clustering around centroids, which a vantage-point tree holds.

Each round builds the tree anew from the centroids and broadcasts it: its size
is that of the centroids, whatever the table's. A vector takes its own
best-first way: of the nodes that it has still to see, the one of the smallest
lower bound comes next, until that bound is beyond its best distance; a node
at that distance is still opened, as a centroid there may have the smaller number.
All distances that decide are sums of integers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved
from .vectors import matrix, scaled, usable

#: Centroids of a leaf: two, or so many that a tree of many centroids has some 64 leaves.
LEAF, LEAVES = 2, 64
#: Bounds come from rounded square roots; by so much they are taken wider, which is far beyond the rounding.
_SLACK = 1e-12


@dataclass
class VantageTree:
    """Nodes by number, the root is 0. A node has its vantage centroid and two children with the ranges of their distances to it, or is a leaf of some centroids."""

    centroids: np.ndarray
    vantage: list[int] = field(default_factory=list)
    children: list[list[tuple[int, float, float]]] = field(default_factory=list)
    members: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._add(np.arange(len(self.centroids)))

    def _add(self, own: np.ndarray) -> int:
        node = len(self.vantage)
        self.vantage.append(-1)
        self.children.append([])
        self.members.append(own)
        if len(own) <= max(LEAF, len(self.centroids) // LEAVES):
            return node
        apart = ((self.centroids[own][:, None] - self.centroids[own][None]) ** 2).sum(2)
        # The centroid whose distances to the others differ most parts them best.
        at = int(np.argmax(np.sqrt(apart.astype(float)).var(1)))
        rest = np.delete(np.arange(len(own)), at)
        far = np.sqrt(apart[at][rest].astype(float))
        order = np.argsort(far, kind="stable")
        half = (len(order) + 1) // 2
        self.vantage[node] = int(own[at])
        self.members[node] = own[[at]]
        for part in (order[:half], order[half:]):
            if len(part):
                self.children[node].append((self._add(own[rest[part]]), float(far[part].min()), float(far[part].max())))
        return node

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each row's nearest centroid, the smaller number at a tie; and how many distances it took."""
        n, nodes = len(rows), len(self.vantage)
        number, best, taken = np.full(n, -1), np.full(n, np.iinfo(np.int64).max), 0
        step = max(64, (1 << 20) // nodes)
        for low in range(0, n, step):
            taken += self._search(rows[low : low + step], number[low : low + step], best[low : low + step])
        return number, best, taken

    def _search(self, rows: np.ndarray, number: np.ndarray, best: np.ndarray) -> int:
        bound = np.full((len(rows), len(self.vantage)), np.inf)
        bound[:, 0], active, taken = 0, np.arange(len(rows)), 0
        while len(active):
            after = np.argmin(bound[active], 1)
            open_ = bound[active, after] <= np.sqrt(best[active].astype(float)) * (1 + _SLACK)
            active, after = active[open_], after[open_]
            for node in np.unique(after):
                own = active[after == node]
                here, bound[own, node] = bound[own, node], np.inf
                for c in self.members[node].tolist():
                    apart = rows[own] - self.centroids[c]
                    d = (apart * apart).sum(1)
                    better = (d < best[own]) | ((d == best[own]) & (c < number[own]))
                    best[own[better]], number[own[better]] = d[better], c
                taken += len(own) * len(self.members[node])
                away = np.sqrt(d.astype(float)) if self.children[node] else None
                for child, near, far in self.children[node]:
                    least = np.maximum(away * (1 - _SLACK) - far * (1 + _SLACK), near * (1 - _SLACK) - away * (1 + _SLACK))
                    bound[own, child] = np.maximum(here, least)
        return taken


def _summed(shared, dims: int, most: int):
    """Of each task: how many vectors each centroid has, and their sum."""
    def run(batches):
        tree = shared.value
        k = len(tree.centroids)
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            rows = matrix(batch.column("v"), dims, most)
            number, _, _ = tree.nearest(rows)
            by = np.argsort(number, kind="stable")
            found, first = np.unique(number[by], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(rows[by], first, 0)
                count += np.bincount(number, minlength=k)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned(shared, dims: int, most: int):
    def run(batches):
        for batch in batches:
            number, best, _ = shared.value.nearest(matrix(batch.column("v"), dims, most))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number, pa.int32()), pa.array(best, pa.int64())], ["id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, *, dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null, NaN or infinite;
    of each component counts floor(scale * x). The first centroids are the ``k``
    vectors with the smallest sha256 of ``seed:id`` (all, if fewer); at equal ids
    the smaller vector comes first. Each round gives a vector to the nearest
    centroid by squared distance, the smaller number at a tie, and moves a
    centroid that has vectors to the floor of their mean; then all are assigned
    once more. Rows with a null id take part but are no first centroids; rows with
    equal ids are vectors of their own; other columns, whatever their names, are
    not read. Without a kept vector there is no row. A scaled component whose
    square, ``dims`` times, is not far below 2**63 is an error. What reaches the
    driver are ``k`` centroids, from sums that Spark has added up.
    """
    spark, most = vectors.sparkSession, int((2**61 // dims) ** 0.5) // 2
    rows = vectors.where(usable(F.col(vector_col)) & (F.size(vector_col) == dims))
    rows = saved(rows.select(F.col(id_col).alias("id"), scaled(F.col(vector_col), scale).alias("v")), "vectors")
    first = rows.where("id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "v").limit(k).select("v").collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    kind = vectors.schema[id_col].dataType.simpleString()
    if not len(centroids):
        out = rows.limit(0).select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
        return out.withColumnRenamed("id", id_col)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(VantageTree(centroids))
        parts = rows.select("v").mapInArrow(_summed(shared, dims, most), "cluster int, n long, sums array<long>")
        parts = parts.select("cluster", "n", F.posexplode("sums").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in parts.collect():  # k * dims at most
            centroids[r["cluster"], r["pos"]] = r["x"] // r["n"]
        shared.unpersist()
    shared = spark.sparkContext.broadcast(VantageTree(centroids))
    out = saved(rows.mapInArrow(_assigned(shared, dims, most), f"id {kind}, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    about = [(c, s, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = out.join(F.broadcast(about), "cluster")  # k rows
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256")


def clusters_sql(dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> str:
    """The same by all distances, in DuckDB's SQL."""
    steps = [f"""
v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, unnest(range({dims})) AS pos, unnest(v) AS x FROM v),
c0 AS (SELECT c, unnest(range({dims})) AS pos, unnest(v) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL) WHERE c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (SELECT r, min_by(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT r, c, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS d FROM x JOIN c{i} AS c USING (pos) GROUP BY r, c) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT c, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY c, pos),
c{i + 1} AS (SELECT o.c, o.pos, CASE WHEN n IS NULL THEN o.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{i} AS o LEFT JOIN m{i} USING (c, pos))""")
    return f"""WITH {",".join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN h USING (c)"""
