"""N-gram Jaccard self-join as a metric-space join, with exact results.

The distance of two documents is 1 - Jaccard of their shingle sets, a metric;
``reach`` is the largest distance of a link. One step is repeated until nothing
is left to part: pivots are drawn from a region, every document goes to the
Voronoi region of its nearest pivot and, as a boundary document, to each other
one whose pivot is at most 2 * reach farther. By the triangle inequality a
linked pair meets in the region of either document. What lies within reach of
a pivot is linked to it at once; a region all of whose documents are linked to
its pivot is done. ``cells`` is this step, for regions of any size.

Where regions come from. Nearly all documents of a corpus share nothing with
any pivot, so all would be boundary documents of all regions. The first regions
are therefore candidates: every set gets tokens, so many that linked sets have
``shared`` of them in common; of these all but the ``shared`` - 1 most frequent
are kept, so linked sets still have one in common; documents that share a kept
one, directly or through others, are one region. Nothing linked is parted by this.

A token is a part of a set: the shingles whose hashes lie in one of a number of
equal ranges, more ranges than linked sets have differing shingles (``Parts``).
Single shingles recur by chance, the more the larger a corpus is, and would tie
most of it into one region; parts of several shingles recur in copies. Where a
link allows so many differing shingles that parts would have less than
``PART`` of them, tokens are a set's smallest hashes (``prefix``).

A region of at most ``task_shingles`` is parted and joined in one task, a
larger one is parted by Spark first. Where pivots can't part a region, as its
documents are about equally far from each other, a task compares the documents
that share a rare shingle; a region too large for a task is put in order of the
distance to a pivot and cut into blocks, and two blocks are joined where the
triangle inequality lets a link cross them. So a task holds ``task_shingles``
shingles, be they many documents, and results are exact at every threshold.

Equal sets are collapsed before all that, links are verified on the sets of
64-bit shingle hashes, and pairs already in one component are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import release, saved
from .words import U64, Piece, mix, pieces

_I64 = np.int64
#: Of names that a task remembers so as not to repeat them; beyond that equal sets are only more work.
_SEEN = 200_000


def shingle_sets(piece: Piece, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each document; a shorter text is one shingle."""
    h = piece.hashes
    n = len(h)
    rolled = h.copy()
    for k in range(1, width):
        rolled[: max(0, n - k)] = mix(rolled[: max(0, n - k)] * U64(0xD6E8FEB86659FD93) + h[k:] + U64(k))
    for a, b in zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            one = h[a : a + 1].copy()
            for k in range(1, b - a):
                one = mix(one * U64(0xD6E8FEB86659FD93) + h[a + k] + U64(k))
            yield mix(one + U64(width + b - a))
        else:
            yield h[:0]


def name_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(np.add.reduce(mix(s ^ U64(0xA24BAED4963EE407)), keepdims=True) + U64(len(s)))[0]) if len(s) else 0


def prefix(n: int, num: int, den: int) -> tuple[int, int]:
    """(taken, shared) of a set of n: any linked set has ``shared`` of its own taken hashes among this one's ``taken`` smallest.

    Linked sets have at least least(n) = ceil(n * num / den) hashes in common,
    n of either. The k-th common hash is at place n - least(n) + k or before in
    both orders, and k may be ``beyond`` of the smaller set, whose size is
    least(n) or more.
    """

    def least(k: int) -> int:
        return -(-k * num // den)

    def beyond(k: int) -> int:
        return max(1, min(k - least(k), least(k)))

    return n - least(n) + beyond(n), beyond(least(n))


#: Shingles that the parts of the largest sets of a class have on average, at least.
PART = 3


class Parts(NamedTuple):
    """The parts of sets that meet in one class of sizes.

    Sets of a class and those of the class below that may link with them meet
    in it. ``edges`` are the bounds of the ranges of hashes, ``salts`` tell parts
    of equal shingles apart. ``most`` is the largest size, ``spare`` the number of
    small parts that a set may leave out: small by their own size, so that equal
    parts are left out of both sets, or of the one that leaves out more.
    """

    most: int
    spare: int
    edges: np.ndarray
    salts: np.ndarray

    def tokens(self, s: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Names of the parts of ``s``; sums: of its mixed hashes, from 0 on."""
        at = np.append(np.searchsorted(s, self.edges), len(s))
        out = mix(sums[at[1:]] - sums[at[:-1]] + self.salts)
        if self.spare:
            size = np.diff(at)
            out = out[size >= np.partition(size, self.spare)[self.spare]]
        return out

    def shared(self, n: int, num: int, den: int) -> int:
        """How many tokens a set of ``n`` has in common with any linked one that it meets here; 0 if it can link with none but equal ones.

        Linked sets differ in (n + m) * (den - num) / (den + num) shingles at
        most, and as many parts; m, the size of the other, is n * den / num at most.
        """
        differ = (n + min(self.most, n * den // num)) * (den - num) // (den + num)
        return len(self.salts) - differ - self.spare if differ else 0


def in_parts(num: int, den: int) -> bool:
    """Whether links allow so few differing shingles that sets are cut into parts."""
    return den + num >= 2 * PART * (den - num)


def classes(n: int, num: int, den: int) -> list[tuple[int, Parts]]:
    """(0 or 1, class): the class of sets of ``n``, and the next one where they may link with sets of it."""
    low, k = 1, 0
    while (high := low + max(1, 3 * low // 7)) <= n:
        low, k = high, k + 1
    out = [(0, _class(k, high - 1, num, den))]
    if n * den // num >= high:  # less than the end of the next class: den / num is 7 / 5 at most
        out.append((1, _class(k + 1, high + max(1, 3 * high // 7) - 1, num, den)))
    return out


@cache
def _class(k: int, most: int, num: int, den: int) -> Parts:
    differ = 2 * most * (den - num) // (den + num)
    slack = differ // 8 + 1
    n = differ + 1 + slack
    edges = np.array([(i << 64) // n for i in range(n)], U64)
    return Parts(most, slack // 2, edges, mix(np.arange(n, dtype=U64) + U64(k << 40)))


def tokens_of(s: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(need, tokens) of a set that is not empty, at most one pair for each class where it may link.

    ``need`` // 2 is ``shared``; ``need`` % 2 tells a set's two classes apart.
    """
    if not in_parts(num, den):
        taken, shared = prefix(len(s), num, den)
        yield 2 * shared, s[:taken]
        return
    sums = np.zeros(len(s) + 1, U64)
    np.cumsum(mix(s), out=sums[1:])
    for up, parts in classes(len(s), num, den):
        if shared := parts.shared(len(s), num, den):
            yield 2 * shared + up, parts.tokens(s, sums)


def _described(width: int):
    def run(batches):
        for batch in batches:
            at = 0
            for piece in pieces(batch.column(2), lower=True):
                n = piece.last - piece.first
                size, name = [], []
                for s in shingle_sets(piece, width):
                    size.append(len(s))
                    name.append(name_of(s))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(size, pa.int64()), pa.array(np.array(name, U64).view(_I64))], ["id", "text_hash", "n", "node"])
                at += n

    return run


def _tokens(width: int, num: int, den: int, slice_: int = 0, slices: int = 1):
    """Texts to (node, token, need) rows: the tokens of each set, of which those of one slice; equal sets of one task give theirs once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for piece in pieces(batch.column(0), lower=True):
                names, tokens, needs = [], [], []
                for s in shingle_sets(piece, width):
                    name = name_of(s)
                    if len(s) and name not in seen:
                        if len(seen) < _SEEN:
                            seen.add(name)
                        for need, own in tokens_of(s, num, den):
                            own = own[own % U64(slices) == U64(slice_)]
                            tokens.append(own)
                            names.append(np.full(len(own), name, U64))
                            needs.append(np.full(len(own), need, np.int32))
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(_I64)), pa.array(np.concatenate(tokens).view(_I64)), pa.array(np.concatenate(needs))], ["node", "token", "need"])

    return run


#: Passes over the texts, each of which shuffles its slice of their tokens, or of them, alone: these shuffles take most of the disk.
SLICES = 2


def _candidates(texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, region) of the sets that may be linked with another; linked sets are in one region."""
    found = None
    for k in range(SLICES):
        tokens = texts.mapInArrow(_tokens(width, num, den, k, SLICES), "node long, token long, need int")
        # Counted where they lie: tokens are shuffled once, and only those of two sets or more are written.
        by = Window.partitionBy("token")
        common = tokens.select("*", F.min("node").over(by).alias("low"), F.max("node").over(by).alias("high"), F.count("*").over(by).alias("rows"))
        common = saved(common.where("low < high").select("node", "token", "need", "rows"), "common")
        found = common if found is None else found.unionByName(common)
        del tokens
        release(texts.sparkSession)  # of the slice, before the next is shuffled
    held = found.groupBy("node", "need").agg(F.collect_set(F.struct("rows", "token")).alias("held")).withColumn("shared", F.expr("cast(need div 2 as int)"))
    held = held.where("size(held) >= shared").select("node", F.explode(F.slice(F.array_sort("held"), F.lit(1), F.expr("size(held) - shared + 1"))).alias("t"))
    kept = saved(held.select("node", "t.token"), "kept")
    ends = kept.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token", "low")
    stars = kept.join(ends, "token").where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    return connected_components(stars).toDF("node", "region")


def _is_named(s: np.ndarray, node: int) -> bool:
    """Whether the set has this name."""
    return name_of(s) == node % (1 << 64)


def _sets(width: int):
    """(region, node, text) to (region, node, body); a task gives a node's set once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            at = 0
            for piece in pieces(batch.column(2), lower=True):
                n = piece.last - piece.first
                regions, nodes = batch.column(0).slice(at, n), batch.column(1).slice(at, n)
                own, body = [], []
                for s, node in zip(shingle_sets(piece, width), nodes.to_pylist(), strict=True):
                    own.append(_is_named(s, node) and node not in seen)
                    if own[-1]:
                        body.append(s.tobytes())
                        if len(seen) < _SEEN:
                            seen.add(node)
                own = pa.array(own, pa.bool_())
                yield pa.RecordBatch.from_arrays([regions.filter(own), nodes.filter(own), pa.array(body, pa.binary())], ["region", "node", "body"])
                at += n

    return run


def distances(pivot: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 - Jaccard of the pivot and each of the sets that lie in ``flat`` from ``start``."""
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    both = np.add.reduceat((pivot[at] == flat).astype(_I64), start)
    return 1 - both / (size + len(pivot) - both)


def cells(d: np.ndarray, reach: float) -> np.ndarray:
    """Of distances by (pivot, document), which documents each pivot's Voronoi region holds, boundary documents included."""
    return d <= d.min(0) + 2 * reach


#: A set within this distance of a pivot needs no pivot of its own: farther ones are in other clusters.
NEAR = 0.5
#: Pivots of one step at most; what they leave unparted is parted by the next.
MOST_PIVOTS = 128


class Region:
    """Sets of one task, and for each the first set of its component as far as links are known.

    ``parted``, ``direct`` and ``rare`` count the sets that a step parted by pivots,
    compared with each other, or compared where they share a rare shingle.
    """

    def __init__(self, sets: list[np.ndarray], num: int, den: int, pivots: int, leaf: int):
        self.parted = self.direct = self.rare = 0
        self.sets, self.num, self.den, self.pivots, self.leaf = sets, num, den, pivots, leaf
        self.reach = 1 - num / den + 1e-9
        self.size = np.array([len(s) for s in sets], _I64)
        self.label = np.arange(len(sets))

    def link(self, x: int, others: np.ndarray) -> None:
        found = np.unique(self.label[np.append(others, x)])
        if len(found) > 1:
            self.label[np.isin(self.label, found)] = found[0]

    def laid(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[members]
        return np.concatenate([self.sets[k] for k in members.tolist()]), np.cumsum(size) - size

    def linked(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that link with x."""
        flat, start = self.laid(others)
        at = np.minimum(np.searchsorted(self.sets[x], flat), len(self.sets[x]) - 1)
        both = np.add.reduceat((self.sets[x][at] == flat).astype(_I64), start)
        return others[self.den * both >= self.num * (self.size[others] + self.size[x] - both)]

    def join(self) -> np.ndarray:
        regions = [np.arange(len(self.sets))]
        while regions:
            members = regions.pop()
            if len(np.unique(self.label[members])) < 2:
                continue
            if len(members) <= self.leaf:
                self.direct += len(members)
                for k in range(len(members) - 1):
                    self.compare(int(members[k]), members[k + 1 :], None)
                continue
            d = self.measure(members)
            within = cells(d, self.reach)
            parts = [members[w] for w in self.outer(within) if len(np.unique(self.label[members[w]])) > 1]
            held = [len(x) for x in parts]
            if 2 * max(held, default=0) <= len(members) and 2 * sum(held) <= 3 * len(members):
                self.parted += len(members)
                regions += parts
            else:
                self.rare += len(members)
                self.by_rare_shingles(members, d)
        return self.label

    @staticmethod
    def outer(within: np.ndarray) -> list[np.ndarray]:
        """The cells without those that lie in another: its join has their links too."""
        out: list[np.ndarray] = []
        for w in within[np.argsort(-within.sum(1), kind="stable")]:
            if not any((v | w == v).all() for v in out):
                out.append(w)
        return out

    def measure(self, members: np.ndarray) -> np.ndarray:
        """Distances to pivots, each as far as can be from those before it; links what they reach.

        There are as many as it takes until all members are near one, so in
        proportion to the clusters of the region, but no more than it has leaves.
        """
        flat, start = self.laid(members)
        rows: list[np.ndarray] = []
        at = len(members) // 2
        for _ in range(min(MOST_PIVOTS, max(self.pivots, len(members) // self.leaf))):
            pivot = int(members[at])
            rows.append(distances(self.sets[pivot], flat, start, self.size[members]))
            near = members[rows[-1] <= self.reach]
            self.link(pivot, self.linked(pivot, near))
            nearest = np.min(rows, 0)
            at = int(np.argmax(nearest))
            if nearest[at] <= NEAR:
                break
        return np.array(rows)

    def compare(self, x: int, others: np.ndarray, least: np.ndarray | None) -> None:
        """Links x with those of ``others`` that differ in component, if sizes and ``least`` differing shingles of each let them."""
        size = self.size
        others = others[(self.label[others] != self.label[x]) & (self.num * size[others] <= self.den * size[x]) & (self.num * size[x] <= self.den * size[others])]
        if least is not None and len(others):
            # A link allows (size + size) * (den - num) / (den + num) differing shingles.
            others = others[(least[others] + least[x]) * (self.den + self.num) <= (size[others] + size[x]) * (self.den - self.num)]
        if len(others):
            self.link(x, self.linked(x, others))

    def by_rare_shingles(self, members: np.ndarray, d: np.ndarray) -> None:
        """Compares the members that share one of the rarest shingles of each; linked sets do."""
        flat, _ = self.laid(members)
        size = self.size[members]
        tokens, place, count = np.unique(flat, return_inverse=True, return_counts=True)
        del flat
        rank = np.empty(len(tokens), np.int32)
        rank[np.argsort(count, kind="stable")] = np.arange(len(tokens), dtype=np.int32)
        owner = np.repeat(np.arange(len(members), dtype=np.int32), size)
        alone = np.zeros(len(self.sets), _I64)  # shingles that no other member has
        alone[members] = np.bincount(owner[count[place] == 1], minlength=len(members))
        token = rank[place]
        order = np.lexsort((token, owner))
        rarest = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(size + 1 + (-size * self.num) // self.den, size)
        token, owner = token[order][rarest], owner[order][rarest]
        del place, order, rarest
        by = np.argsort(token, kind="stable")
        who = owner[by]
        new = np.append(np.flatnonzero(np.diff(token[by], prepend=-1)), len(by))
        group = np.empty(len(by), _I64)  # of each (member, token), the token's group
        group[by] = np.repeat(np.arange(len(new) - 1), np.diff(new))
        bounds = np.searchsorted(owner, np.arange(len(members) + 1))
        for x in range(len(members)):
            own = group[bounds[x] : bounds[x + 1]]
            spans = [who[new[g] : new[g + 1]] for g in own.tolist() if new[g + 1] - new[g] > 1]
            if not spans:
                continue
            others = np.unique(np.concatenate(spans))
            others = others[others > x]
            others = others[(np.abs(d[:, others] - d[:, x : x + 1]) <= self.reach).all(0)]
            self.compare(int(members[x]), members[others], alone)


def region_links(sets: list[np.ndarray], num: int, den: int, pivots: int = 8, leaf: int = 24) -> np.ndarray:
    """For each set the first set of its component; sets link when den * intersection >= num * union. Exact."""
    return Region(sets, num, den, pivots, leaf).join()


def _joined(width: int, num: int, den: int):
    """(region, node, text or set) sorted by region and node: joins each region's sets; gives (a, b) edges to the first set of the component."""

    def flush(nodes: list[int], bodies: list[bytes]):
        first = region_links([np.frombuffer(b, U64) for b in bodies], num, den)
        own = np.array(nodes, _I64)
        apart = np.flatnonzero(first != np.arange(len(first)))
        return pa.RecordBatch.from_arrays([pa.array(own[apart]), pa.array(own[first[apart]])], ["a", "b"])

    def bodies_of(column):
        if pa.types.is_binary(column.type):
            return (x.as_py() for x in column)
        return (s.tobytes() for piece in pieces(column, lower=True) for s in shingle_sets(piece, width))

    def run(batches):
        region, nodes, bodies = None, [], []
        for batch in batches:
            for r, node, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bodies_of(batch.column(2)), strict=True):
                if r == region and node == nodes[-1]:
                    continue  # a repeated row
                if not _is_named(np.frombuffer(body, U64), node):
                    continue
                if r != region:
                    if len(nodes) > 1:
                        yield flush(nodes, bodies)
                    region, nodes, bodies = r, [], []
                nodes.append(node)
                bodies.append(body)
        if len(nodes) > 1:
            yield flush(nodes, bodies)

    return run


_PARTS = "parent long, region long, node long, pivot long, n long, linked boolean, home boolean, far array<double>"


def _voronoi(num: int, den: int):
    """(region, node, body, pivots) to _PARTS rows, one for each Voronoi region that holds the node.

    linked: with the region's pivot; far: with the nearest one, the distances to all pivots.
    """
    reach = 1 - num / den + 1e-9

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for r, node, body, pivots in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                s = np.frombuffer(body, U64)
                both = np.array([len(np.intersect1d(s, np.frombuffer(p["body"], U64), assume_unique=True)) for p in pivots])
                either = np.array([len(s) + len(p["body"]) // 8 for p in pivots]) - both
                d, linked = 1 - both / either, den * both >= num * either
                home = int(np.argmin(d))
                for k in np.flatnonzero(cells(d[:, None], reach)[:, 0]).tolist():
                    region = int(mix(np.array([(r * 0x9E3779B97F4A7C15 + k + 1) % (1 << 64)], U64)).view(_I64)[0])
                    out.append((r, region, node, pivots[k]["node"], len(s), bool(linked[k]), k == home, d.tolist() if k == home else None))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.list_(pa.float64())]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], [f.split()[0] for f in _PARTS.split(", ")])

    return run


def _blocks(parts: DataFrame, reach: float, block: int) -> DataFrame:
    """(region, node): regions that pivots can't part, in pairs of blocks of about ``block`` shingles.

    Documents linked with the pivot of most links come first, all in order of
    their distance to it. Two blocks of linked documents are in one component
    already, and blocks farther apart than ``reach`` hold no link.
    """
    rows = parts.where("home").select("parent", "node", "n", "far")
    sure = reach - 2e-9  # within this, a distance is a link however it was rounded
    linked = rows.select("parent", F.posexplode("far").alias("k", "d")).groupBy("parent", "k").agg(F.count_if(F.col("d") <= sure).alias("c"))
    best = linked.groupBy("parent").agg(F.max_by("k", F.struct("c", "k")).alias("k"))
    rows = rows.join(best, "parent").select("parent", "node", "n", F.get("far", F.col("k")).alias("far"))
    rows = rows.withColumn("near", F.col("far") <= sure).withColumn("step", F.floor(F.col("far") * 1024))
    hist = rows.groupBy("parent", "near", "step").agg(F.sum("n").alias("w"))
    before = Window.partitionBy("parent").orderBy(F.desc("near"), "step").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    even = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / (1 << 20)
    rows = rows.join(hist, ["parent", "near", "step"]).withColumn("block", F.floor((F.col("before") + even * F.col("w")) / block))
    rows = saved(rows.select("parent", "node", "block", "far", "near"), "blocks")
    sized = rows.groupBy("parent", "block").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.min("near").alias("closed"))
    other = sized.toDF("parent", "block2", "low2", "high2", "closed2")
    pairs = sized.join(other, "parent").where("block <= block2 and not (closed and closed2)")
    pairs = pairs.where((F.col("low2") - F.col("high") <= reach) & (F.col("low") - F.col("high2") <= reach))
    pairs = pairs.select("parent", F.xxhash64("parent", "block", "block2").alias("region"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    return rows.join(pairs, ["parent", "block"]).select("region", "node")


def _dealt(members: DataFrame, held: DataFrame, num: int, den: int, task_shingles: int, pivots: int = 8, rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """(regions of at most ``task_shingles``, links found with pivots) of regions (region, node, n), by ``cells`` or, where these don't part one, by blocks.

    The sets, ``held`` (node, body), are joined to a round's large regions once,
    and to the regions that come out.
    """
    reach = 1 - num / den + 1e-9
    done, links = [], []
    for k in range(rounds + 1):
        large = saved(members.groupBy("region").agg(F.sum("n").alias("w")).where(F.col("w") > task_shingles), "regions")
        done.append(members.join(large, "region", "left_anti").select("region", "node"))
        if large.isEmpty():
            break
        big = members.join(large.select("region"), "region", "left_semi")
        drawn = big.groupBy("region").agg(*(F.min_by("node", F.xxhash64("node", F.lit(p))).alias(f"p{p}") for p in range(pivots)))
        drawn = drawn.select("region", F.explode(F.array_distinct(F.array(*(f"p{p}" for p in range(pivots))))).alias("node"))
        drawn = drawn.join(held, "node").groupBy("region").agg(F.array_sort(F.collect_list(F.struct("node", "body"))).alias("pivots"))
        parts = big.select("region", "node").join(held, "node").join(drawn, "region").select("region", "node", "body", "pivots").mapInArrow(_voronoi(num, den), _PARTS)
        parts = saved(parts, "parts")  # without the sets, which go to many regions where pivots part badly
        links.append(parts.where("linked and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        open_ = parts.groupBy("parent", "region").agg(F.sum("n").alias("w"), F.min("linked").alias("closed")).where("not closed")
        fit = open_.groupBy("parent").agg(F.max("w").alias("most"), F.sum("w").alias("all"))
        fit = saved(large.join(fit, large.region == fit.parent).select("parent", F.expr(f"{k} < {rounds} and 2 * most <= w and 2 * all <= 3 * w").alias("parted")), "regions")
        done.append(_blocks(parts.join(fit.where("not parted"), "parent", "left_semi"), reach, task_shingles // 2))
        inner = parts.join(open_.select("parent", "region"), ["parent", "region"], "left_semi").join(fit.where("parted"), "parent", "left_semi")
        members = saved(inner.select("region", "node", "n"), "members")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    found = links[0] if links else out.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    for part in links[1:]:
        found = found.unionByName(part)
    return out.join(held, "node").select("region", "node", "body"), found


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, num: int = 90, den: int = 100, task_shingles: int = 2_000_000) -> DataFrame:
    """(id, text_hash, n, comp) of each row: size of its set and the name of its component, null for a text without words.

    text_hash is xxhash64 of the text as string. Rows, links, nulls and repeats
    are those of ``jaccard_components``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select("id", F.xxhash64("text").alias("text_hash"), "text")
    id_type = rows.schema["id"].dataType.simpleString()
    described = saved(rows.mapInArrow(_described(width), f"id {id_type}, text_hash long, n long, node long"), "described")
    regions = _candidates(rows.select("text"), width, num, den)

    # One row of each candidate set gives the set again, if possible one with an id.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("f")
    witness = described.where("n > 0").groupBy("node").agg(first, F.min("n").alias("n")).select("node", "n", "f.id", "f.text_hash")
    wanted = saved(witness.join(regions, "node"), "candidates")
    del regions
    release(docs.sparkSession)  # of the tokens, by far the largest shuffle
    large = wanted.groupBy("region").agg(F.sum("n").alias("w")).where(F.col("w") > task_shingles).select("region")
    wanted_ids = wanted.select(F.col("id").alias("id2"), "text_hash", "region", "node").hint("shuffle_hash")
    texts = None
    for k in range(SLICES):
        some = rows.where(F.pmod("text_hash", F.lit(SLICES)) == k)
        some = some.join(wanted_ids, (some.id.eqNullSafe(F.col("id2"))) & (some.text_hash == wanted_ids.text_hash)).select("region", "node", "text")
        some = saved(some, "texts")  # read once or twice, but all texts are shuffled once
        texts = some if texts is None else texts.unionByName(some)
        release(docs.sparkSession)

    def joined(members: DataFrame) -> DataFrame:
        # By a hash of the region: Spark takes a union of joins by region as dealt by it and drops a second deal,
        # but then merges the partitions of each of its sides alone, which parts regions.
        return members.repartition(F.xxhash64("region")).sortWithinPartitions("region", "node").mapInArrow(_joined(width, num, den), "a long, b long")

    if large.isEmpty():
        # Candidate regions are apart, so the stars made in one are components already.
        comp = saved(joined(texts), "edges").toDF("node", "comp")
    else:
        sets = texts.join(large, "region", "left_semi").mapInArrow(_sets(width), "region long, node long, body binary")
        held = saved(sets.select("node", "body"), "sets")
        parts, links = _dealt(wanted.join(large, "region", "left_semi").select("region", "node", "n"), held, num, den, task_shingles)
        comp = connected_components(joined(texts.join(large, "region", "left_anti")).union(joined(parts)).union(links))
    del texts
    release(docs.sparkSession)
    found = described.join(comp, "node", "left")
    return found.select("id", "text_hash", "n", F.expr("case when n > 0 then coalesce(comp, node) end").alias("comp"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, num: int = 90, den: int = 100, task_shingles: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (long), component_id.

    Rows link when ``den * intersection >= num * union`` of their sets of
    distinct ``width``-word shingles (A-Z lower-cased; a text with fewer words
    is one shingle). component_id is the smallest id that links reach. Null,
    empty and blank texts have no shingles and are linked with nothing; their
    component_id is their id. Equal texts are linked. A row is a document of
    its own, whatever its id: ids that repeat with different texts are linked
    by their texts alone, repeated rows give repeated results, and a null id
    links like others and takes its component's smallest id (null if all are
    null). Texts of any length are taken whole. Columns other than the two are
    ignored. An empty table gives no rows. Sets are compared by 64-bit hashes.
    """
    rows = jaccard_classes(docs, id_col, text_col, width=width, num=num, den=den, task_shingles=task_shingles)
    lowest = rows.where("comp is not null").groupBy("comp").agg(F.min("id").alias("component_id"))
    rows = rows.join(lowest, "comp", "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
