"""Connected components of an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard
from .storage import saved

#: Rays of a hub that one partition gets at a time.
RAYS = 1000


def _contracted(batches):
    """Ties every node of this partition's edges to the smallest node that these edges reach."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    out = [(x, r) for x in list(up) if (r := root(x)) != x]
    for i in range(0, len(out), 100_000):
        part = out[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``; comp is the smallest node it reaches.

    A round sends each edge to the partitions of both its ends, where all edges
    at hand are contracted to stars around their smallest nodes. It is over
    when each node has one star and no centre is a ray. A hub of over ``RAYS``
    edges is split over as many partitions as it needs; an edge in which it is
    a ray goes to them all. Each round's table is written to the shared folder.
    Null ends and loops are ignored; an empty table gives no rows.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b")
    now = saved(now.distinct(), "edges")
    while True:
        hubs = now.groupBy("b").count().where(F.col("count") > RAYS).select(F.col("b").alias("hub"), F.ceil(F.col("count") / RAYS).cast("int").alias("parts"))
        rays = now.join(hubs, now.a == hubs.hub, "left").select("a", "b", F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        centres = now.join(hubs, now.b == hubs.hub, "left").select("a", "b", F.col("b").alias("key"), F.expr("pmod(xxhash64(a), coalesce(parts, 1))").cast("int").alias("part"))
        both = rays.union(centres).repartition("key", "part").select("a", "b")
        last, now = now, saved(both.mapInArrow(_contracted, "a long, b long").distinct(), "edges")
        discard(last)
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("ray"), F.lit(0).alias("hub")), F.struct(F.col("b").alias("node"), F.lit(0).alias("ray"), F.lit(1).alias("hub")))).alias("e")).select("e.*")
        ends = ends.groupBy("node").agg(F.sum("ray").alias("rays"), F.max("hub").alias("hub"))
        if ends.where("rays > 1 or (rays = 1 and hub = 1)").isEmpty():
            break
    return now.toDF("node", "comp").union(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
