"""Hard negatives by a multiway hyperplane tree over integer vectors.

The tree is fitted on a bounded sample: a node has a few split points, a row
goes to the child of the nearest one. Every row of the table is led to its
leaf, and over all rows each split point learns the range of its distances to
the subtree of each sibling. A query asks for scores within a window. With the
squared norms of a subtree that is an annulus of distances around the query, and
with the query's distance to a split point it is a range of distances to that
point; a sibling whose own range doesn't meet it is left out. What is left is
scored exactly. Leaves are dealt out in blocks of bounded size, queries in groups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved
from .vectors import matrix, scaled, usable

#: Split points of a node; a node of at most LEAF rows of the sample is a leaf.
ARITY, LEAF = 8, 64
#: Rows of the sample that the tree is fitted on, which also gives first bounds of the best scores.
SAMPLE = 2048
#: Least and most rows of a block, and most queries of a group.
BLOCK, GROUP = (512, 65_536), 65_536
#: Scores that are computed at once.
_AT_ONCE = 1 << 22
#: Distances are rounded square roots; ranges are taken wider by so much.
_SLACK = 1e-9


def _squares(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, exact: sums of integers below 2**53."""
    a, b = rows.astype(float), points.astype(float)
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)


@dataclass
class HyperplaneTree:
    """Nodes by number, the root is 0; a leaf has no split points. near[n][i, j] and far[n][i, j] are the least and greatest distance from split point i to a row under child j, low and high the squared norms of a child's rows, set by ``learn``."""

    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    near: dict[int, np.ndarray] = field(default_factory=dict)
    far: dict[int, np.ndarray] = field(default_factory=dict)
    low: dict[int, np.ndarray] = field(default_factory=dict)
    high: dict[int, np.ndarray] = field(default_factory=dict)
    looked: int = 0
    skipped: int = 0

    def grow(self, rows: np.ndarray) -> int:
        """Fits the subtree of a sample. Split points are spread: each next one is the row farthest from those before."""
        node = len(self.points)
        self.points.append(rows[:0])
        self.children.append([])
        if len(rows) <= LEAF:
            return node
        chosen, apart = [0], _squares(rows, rows[:1])[:, 0]
        while len(chosen) < ARITY and apart.max() > 0:
            chosen.append(int(np.argmax(apart)))
            apart = np.minimum(apart, _squares(rows, rows[chosen[-1:]])[:, 0])
        if len(chosen) > 1:
            self.points[node] = rows[chosen]
            side = np.argmin(_squares(rows, rows[chosen]), 1)
            self.children[node] = [self.grow(rows[side == j]) for j in range(len(chosen))]
        return node

    def route(self, rows: np.ndarray, seen=None) -> np.ndarray:
        """The leaf of each row; ``seen`` is called with each node that rows pass, these rows, their squared distances to its split points and their child."""
        leaf, todo = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            leaf[own] = node
            if len(own) and len(self.points[node]):
                d = _squares(rows[own], self.points[node])
                side = np.argmin(d, 1)
                if seen:
                    seen(node, own, d, side)
                todo += [(child, own[side == j]) for j, child in enumerate(self.children[node])]
        return leaf

    def learn(self, ranges: list) -> None:
        """Takes (node, point, child, least, greatest) over all rows: squared distances, and with point -1 squared norms. A child without rows is in no range."""
        for n, p in enumerate(self.points):
            k = len(p)
            self.near[n], self.far[n] = np.full((k, k), np.inf), np.full((k, k), -np.inf)
            self.low[n], self.high[n] = np.full(k, np.inf), np.full(k, -np.inf)
        for n, i, j, least, most in ranges:
            if i < 0:
                self.low[n][j], self.high[n][j] = least, most
            else:
                self.near[n][i, j], self.far[n][i, j] = np.sqrt(least), np.sqrt(most)

    def search(self, rows: np.ndarray, least: np.ndarray, most: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows that look there): leaves that may hold a score within [least, most] of a row."""
        norm, out, todo = (rows.astype(float) ** 2).sum(1), [], [(0, np.flatnonzero(least <= most))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if not len(self.points[node]):
                out.append((node, own))
                continue
            away = np.sqrt(np.maximum(_squares(rows[own], self.points[node]), 0))[:, :, None]
            # squared distance = norms - 2 * score
            inner = np.sqrt(np.maximum(norm[own][:, None] + self.low[node] - 2 * most[own][:, None], 0))[:, None, :] * (1 - _SLACK)
            square = norm[own][:, None] + self.high[node] - 2 * least[own][:, None]
            outer = np.sqrt(np.maximum(square, 0))[:, None, :] * (1 + _SLACK)
            near, far = self.near[node][None] * (1 - _SLACK), self.far[node][None] * (1 + _SLACK)
            meets = (near <= away * (1 + _SLACK) + outer) & (far >= np.maximum(away * (1 - _SLACK) - outer, inner - away * (1 + _SLACK)))
            meets = meets.all(1) & (square >= 0) & np.isfinite(self.low[node])
            self.looked += meets.size
            self.skipped += meets.size - int(meets.sum())
            todo += [(child, own[meets[:, j]]) for j, child in enumerate(self.children[node])]
        return out


def _routed(shared, dims: int, most: int):
    def run(batches):
        for batch in batches:
            leaf = shared.value.route(matrix(batch.column("v"), dims, most))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], [*batch.schema.names, "leaf"])

    return run


def _ranges(shared, dims: int, most: int):
    """Of each task: the ranges of the rows that it has led."""
    def run(batches):
        tree: HyperplaneTree = shared.value
        found: dict[tuple[int, int, int], tuple[float, float]] = {}

        def take(key, values):
            low, high = found.get(key, (np.inf, -np.inf))
            found[key] = (min(low, float(values.min())), max(high, float(values.max())))

        for batch in batches:
            rows = matrix(batch.column("v"), dims, most)
            norm = (rows * rows).sum(1)

            def seen(node, own, d, side, norm=norm):
                for j in np.unique(side).tolist():
                    take((node, -1, j), norm[own[side == j]])
                    for i in range(d.shape[1]):
                        take((node, i, j), d[side == j, i])

            tree.route(rows, seen)
        columns = list(zip(*((*k, *v) for k, v in found.items()), strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.float64()] * 2, strict=True)], ["node", "point", "child", "least", "most"])

    return run


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, the smaller id first at a tie."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _first_bound(shared, dims: int, most: int, k: int):
    """(least, most) for the ``k`` best rows of the same label: the sample has as many that score ``least``."""
    def run(batches):
        tree, s_row, s_label, s_v = shared.value
        for batch in batches:
            v = matrix(batch.column("v"), dims, most).astype(float)
            row, label = np.asarray(batch.column("row")), np.asarray(batch.column("label"))
            scores = v @ s_v.T.astype(float)
            scores[(label[:, None] != s_label) | (row[:, None] == s_row)] = -np.inf
            kth = -np.partition(-scores, k - 1, 1)[:, k - 1] if scores.shape[1] >= k else np.full(len(v), -np.inf)
            yield from _looking(tree, batch, v, [(kth[:, None], np.full((len(v), 1), np.inf))])

    return run


def _looking(tree: HyperplaneTree, batch: pa.RecordBatch, v: np.ndarray, windows: list):
    """A row for each query and leaf that it must look into, with its window's bounds."""
    for least, most in windows:
        for leaf, own in tree.search(v, least.min(1), most.max(1)):
            kept = batch.take(pa.array(own))
            bounds = [pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * x.shape[1], pa.int32()), pa.array(x[own].ravel())) for x in (least, most)]
            yield pa.RecordBatch.from_arrays([kept.column("row"), kept.column("label"), kept.column("v"), *bounds, pa.array(np.full(len(own), leaf), pa.int32())], ["row", "label", "v", "least", "most", "leaf"])


def _window_bound(shared, dims: int, most: int, k: int):
    """(least, most) of each positive's window, its lower end raised to a score that ``k`` rows of the sample reach within it."""
    def run(batches):
        tree, _, s_label, s_v = shared.value
        for batch in batches:
            v = matrix(batch.column("v"), dims, most).astype(float)
            label = np.asarray(batch.column("label"))
            column = batch.column("positives")
            long = np.diff(np.asarray(column.offsets))
            p = np.full((len(v), max(1, int(long.max(initial=0)))), -1.0)
            p[np.arange(p.shape[1]) < long[:, None]] = np.asarray(column.flatten(), float)
            low, high = np.ceil(p / 2), np.floor(95 * p / 100)
            low[p < 0], high[p < 0] = np.inf, -np.inf  # no window below a negative score
            scores = v @ s_v.T.astype(float)
            scores[label[:, None] == s_label] = np.nan
            for i in range(p.shape[1]):
                inside = np.where((scores >= low[:, i : i + 1]) & (scores <= high[:, i : i + 1]), scores, -np.inf)
                if inside.shape[1] >= k:
                    low[:, i] = np.maximum(low[:, i], -np.partition(-inside, k - 1, 1)[:, k - 1])
            yield from _looking(tree, batch, v, [(low, high)])

    return run


def _leaf_scores(dims: int, most: int, k: int, same: bool):
    """Scores of a block's rows for the queries that look into it: per query and window the ``k`` best of the same label, or of others."""
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and queries.num_rows:
            v, ids, label, row = (matrix(rows["v"], dims, most).astype(float).T, *(np.asarray(rows[c]) for c in ("id", "label", "row")))
            step = max(1, _AT_ONCE // len(ids))
            for at in range(0, queries.num_rows, step):
                part = queries.slice(at, step).combine_chunks()
                q_row, q_label = np.asarray(part["row"]), np.asarray(part["label"])
                low, high = (np.asarray(part[c].combine_chunks().flatten()).reshape(len(q_row), -1) for c in ("least", "most"))
                scores = matrix(part["v"], dims, most).astype(float) @ v
                fits = ((label == q_label[:, None]) == same) & (row != q_row[:, None]) & (scores >= low.min(1)[:, None])
                for i in range(len(q_row)):
                    own = np.flatnonzero(fits[i])
                    for w in range(low.shape[1]):
                        inside = own[(scores[i, own] >= low[i, w]) & (scores[i, own] <= high[i, w])]
                        best = inside[_best(scores[i, inside], ids[inside], k)]
                        if len(best):
                            out.append((np.full(len(best), q_row[i]), np.full(len(best), w), scores[i, best].astype(np.int64), ids[best], row[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query", "slot", "score", "id", "row"), columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)})

    return run


def _searched(blocks: DataFrame, sizes: DataFrame, looks: DataFrame, groups: int, scores, k: int) -> DataFrame:
    """(query, slot, score, id, row): the ``k`` best over all leaves. Rows of a block meet a group of queries in one task; the best of each task alone travel on."""
    left = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = looks.join(F.broadcast(sizes), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = right.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    key = ["leaf", "block", "group"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(scores, "query long, slot int, score long, id long, row long")
    rank = F.row_number().over(Window.partitionBy("query", "slot").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor, *, label=None, scale: int = 256, positives: int = 5, negatives: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is the inner product with the anchor of floor(scale * x), an
    integer; higher ones come first, at a tie the smaller id. An anchor (boolean
    column ``anchor``) has its first ``positives`` other rows of the same label,
    and for each of these the first ``negatives`` rows of another label with
    50 * positive <= 100 * negative <= 95 * positive score; all, where there are
    fewer. ``label`` is a column to take in place of ``label_col``.

    Rows with a null id, label or vector, or a component that is null or not
    finite, take no part. Rows with equal ids are rows of their own, an anchor is
    not its own positive; a shorter vector counts as one that ends in zeros. An
    empty table gives no row; other columns, whatever their names, are not read.
    A component for which sums would not be exact below 2**50 is an error.

    The tree, its ranges and the sample (of at most SAMPLE rows) are broadcast,
    and nothing else; every row is indexed, and no bound is on the rows of a leaf.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("id is not null and label is not null").where(usable(F.col("v"))).select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", scaled(F.col("v"), scale).alias("v"))
    rows = saved(rows, "rows")
    seen = rows.agg(F.max(F.size("v")).alias("dims"), F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).first()
    dims, out = max(1, seen["dims"] or 0), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    most = int((2**50 // dims) ** 0.5)
    if not seen["anchors"]:
        return spark.createDataFrame([], out)
    drawn = rows.orderBy(F.xxhash64("id", "v"), "id", "row").limit(SAMPLE).select("row", "label", "v").toArrow()
    s_row, s_label, s_v = np.asarray(drawn["row"]), np.asarray(drawn["label"]), matrix(drawn["v"], dims, most)
    tree = HyperplaneTree()
    tree.grow(s_v)

    routed = saved(rows.mapInArrow(_routed(spark.sparkContext.broadcast(tree), dims, most), "row long, id long, label long, anchor boolean, v array<bigint>, leaf int"), "routed")
    ranges = routed.select("v").mapInArrow(_ranges(spark.sparkContext.broadcast(tree), dims, most), "node int, point int, child int, least double, most double")
    tree.learn([tuple(r) for r in ranges.groupBy("node", "point", "child").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()])
    shared = spark.sparkContext.broadcast((tree, s_row, s_label, s_v))
    size = max(BLOCK[0], min(BLOCK[1], seen["n"] // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    sizes = spark.createDataFrame([(r["leaf"], -(-r["n"] // size)) for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect()], "leaf int, blocks int")
    blocks = routed.join(F.broadcast(sizes), "leaf").select("row", "id", "label", "v", "leaf", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"))
    groups = -(-seen["anchors"] // GROUP)

    asked = routed.where("anchor").select("row", "id", "label", "v")
    looks = asked.mapInArrow(_first_bound(shared, dims, most, positives), "row long, label long, v array<bigint>, least array<double>, most array<double>, leaf int")
    own = saved(_searched(blocks, sizes, looks, groups, _leaf_scores(dims, most, positives, True), positives), "positives")
    slots = own.groupBy("query").agg(F.sort_array(F.collect_set("score")).alias("positives"))  # at most ``positives`` of each
    asked = asked.join(slots, asked["row"] == slots["query"]).drop("query")
    looks = asked.mapInArrow(_window_bound(shared, dims, most, negatives), "row long, label long, v array<bigint>, least array<double>, most array<double>, leaf int")
    other = _searched(blocks, sizes, looks, groups, _leaf_scores(dims, most, negatives, False), negatives).select("query", "slot", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    pairs = own.join(slots, "query").select("query", (F.array_position("positives", F.col("score")) - 1).cast("int").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = pairs.join(other, ["query", "slot"]).join(routed.where("anchor").select(F.col("row").alias("query"), F.col("id").alias("anchor_id")), "query")
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


HARD_NEGATIVES_SQL = """WITH v AS (
  SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.id AS anchor_id, x.r, x.id, a.label = x.label AS same, CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score FROM v AS a, v AS x WHERE a.id % 50 = 0 AND a.r <> x.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, r) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.id, s.r) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
