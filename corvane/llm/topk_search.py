"""Exact top-k by inner product: dual-tree search with cover trees over queries and data.

Vectors are made integers, component by component, floor(scale * x), and scores are integer inner products.

Data: equal vectors become one point that carries the k + 1 smallest of its ids: more can't be in any result, as ties go
to smaller ids and only a query's own id is passed over.  Points are dealt into groups by the nearest of a few pivots, and
groups into blocks of about ``BLOCK`` points by a hash, so that a group of any size is many tasks.  Each block becomes
a cover tree: a node covers its points within a radius; its children lie within half the scale of the level above and
further than that from each other; the points of children with few points share leaves, which are bins about a mean.
Queries are put into blocks and trees in the same way.

Search: query blocks are taken in rounds of about ``ROUND_BYTES``, which go to every task, and the data's blocks are read
where they are stored, so that neither moves with the other.  First each data block meets the query blocks of its own
group, which gives queries a k-th score.  Then every data block meets the others: the bound of all query blocks with it is
found at once, and those whose queries can't gain are passed over.  Within two blocks the trees are descended together, and
two nodes are passed over where their bound is below the worst k-th score of the query node; it rises as a task goes on.
The bound of two nodes with centres c and d and radii r and s is c.d + r|d| + s|c| + r s: no pair scores more.  What leaves
a task is each query's best k there.  The number of rounds grows with the query set, and the data is read once more for each.

Defined results: vectors that are null, hold null or non-finite components, or differ in length from the most common
length (the smaller one if two are as common) take no part, as query or data; a null id takes no part; rows that repeat an
id are one candidate with its best score; a query finds all candidates if there are fewer than k; an empty table gives an
empty result; other columns aren't carried.  A component of 2 ** 62 or more after scaling is an error, and so is a score
that 64 bits might not hold; scores from 2 ** 52 on are computed in integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import shared_folder

from .common import clear_stored, level, made, stored, written

#: Points of a block, points of a leaf, pivots, and the rows that pivots are drawn from, at most.
BLOCK, LEAF, PIVOTS, PIVOT_ROWS = 2048, 96, 16, 1024
#: Points up to which a child has no node of its own.
FEW = 4
#: Bytes of the query trees of a round, about.
ROUND_BYTES = 1 << 25
#: What a bound may lose to rounding, as a part of the norms' product.
ROUNDING = 1e-12
NONE = np.iinfo(np.int64).min


class CoverTree:
    """Nodes as arrays.  The points of a node are points[begin:end] in the tree's own order; its children, nodes[child:last]."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.order = np.arange(len(points))
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        exact = points.astype("f8")
        if len(points):
            self._build(exact)
        self.points, self.ids = np.asarray(points)[self.order].astype(np.int64), ids[self.order]
        self.at = np.asarray(self.center).reshape(len(self.center), -1)
        self._prepare()

    def _prepare(self) -> None:
        self.exact = self.points.astype("f8")
        self.longest = float(np.sqrt((self.exact**2).sum(axis=1)).max(initial=0.0))
        self.norm = np.sqrt((self.at**2).sum(axis=1))
        self.reach = np.asarray(self.radius)

    def pack(self) -> bytes:
        out = BytesIO()
        counts = np.asarray([len(c) for c in self.children], np.int64)
        below = np.asarray([c for own in self.children for c in own], np.int64)
        wide = "<i8" if np.abs(self.points).max(initial=0) >= 2**31 else "<i4"
        np.savez(out, order=self.order, points=self.points.astype(wide), ids=self.ids, at=self.at, radius=np.asarray(self.radius), span=np.asarray(self.span, np.int64), counts=counts, below=below)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> CoverTree:
        own, got = cls.__new__(cls), np.load(BytesIO(data))
        own.order, own.points, own.ids, own.at = got["order"], got["points"].astype(np.int64), got["ids"], got["at"]
        own.radius, own.span = got["radius"].tolist(), list(map(tuple, got["span"].tolist()))
        ends = np.cumsum(got["counts"])
        own.children = [c.tolist() for c in np.split(got["below"], ends[:-1])] if len(ends) else []
        own._prepare()
        return own

    def _node(self, center: np.ndarray, far: float, begin: int, end: int) -> int:
        self.center.append(center)
        self.radius.append(far)
        self.span.append((begin, end))
        self.children.append([])
        return len(self.center) - 1

    def _build(self, x: np.ndarray) -> None:
        first = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
        root = self._node(x[0], float(first.max()), 0, len(x))
        scale = float(2 ** np.ceil(np.log2(max(first.max(), 1e-9))))
        waiting = [(root, scale)]
        while waiting:
            node, scale = waiting.pop()
            begin, end = self.span[node]
            if end - begin <= LEAF or self.radius[node] == 0:
                continue
            rest, half = self.order[begin:end], scale / 2
            center, parts, lone = self.center[node], [], []
            while len(rest):
                # the node's own centre is the first child's; each further centre is a point that no child covers
                far = np.sqrt(((x[rest] - center) ** 2).sum(axis=1))
                inside = far <= half
                taken = rest[inside]
                if len(taken) > FEW:
                    parts.append((center, float(far[inside].max()), taken, half))
                else:
                    lone.append(taken)
                rest = rest[~inside]
                if len(rest):
                    center = x[rest[0]]
            # children of a few points share leaves about their mean
            few = np.concatenate(lone) if lone else np.zeros(0, int)
            for i in range(0, len(few), LEAF):
                taken = few[i : i + LEAF]
                mean = x[taken].mean(axis=0)
                parts.append((mean, float(np.sqrt(((x[taken] - mean) ** 2).sum(axis=1)).max()), taken, 0.0))
            at = begin
            for center, far, taken, below in parts:
                self.order[at : at + len(taken)] = taken
                child = self._node(center, far, at, at + len(taken))
                self.children[node].append(child)
                at += len(taken)
                if below:
                    waiting.append((child, below))


def bound(c: np.ndarray, r: float, d: np.ndarray, s: np.ndarray, c_norm: float, d_norm: np.ndarray) -> np.ndarray:
    """At least the score of any two points within r of c and within s of d."""
    return d @ c + r * d_norm + s * c_norm + r * s + 1e-3 + ROUNDING * (c_norm + r) * (d_norm + s)


def scored(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: of floats where they hold every sum exactly."""
    return np.rint(a @ b.T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Best:
    """The best k of each query of a block: scores and ids, NONE for missing ones, and the score that each is known to reach."""

    scores: np.ndarray
    ids: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, queries: int, k: int, floor: np.ndarray | None = None) -> Best:
        least = np.full(queries, -np.inf) if floor is None else floor.astype("f8")
        return cls(np.full((queries, k), NONE), np.full((queries, k), np.iinfo(np.int64).max), least)


def search(queries: CoverTree, data: CoverTree, best: Best, seen: list[int] | None = None) -> None:
    """Put the data's points into the best of the queries, in the query tree's order.  seen: counts of pairs that were scored.

    A point's ids are ascending and padded with -1.
    """
    k, ids, query_ids, least = best.scores.shape[1], data.ids, queries.ids[:, 0], best.least
    product = queries.longest * data.longest
    if product >= 2.0**63 * (1 - 1e-9):
        raise OverflowError("scores beyond 64 bits")
    exact = product < 2.0**52
    sides = (queries.exact, data.exact) if exact else (queries.points, data.points)
    waiting = [(0, np.zeros(1, np.int64))] if len(queries.points) and len(data.points) else []
    while waiting:
        q, nodes = waiting.pop()
        begin, end = queries.span[q]
        worst = least[begin:end].min()
        upper = bound(queries.at[q], queries.reach[q], data.at[nodes], data.reach[nodes], queries.norm[q], data.norm[nodes])
        keep = upper >= worst
        nodes, upper = nodes[keep], upper[keep]
        if not len(nodes):
            continue
        nodes = nodes[np.argsort(upper)]  # the last is taken first
        inner = [n for n in nodes if data.children[n]]
        if queries.children[q] and (not inner or queries.reach[q] >= data.reach[nodes].max()):
            waiting += [(child, nodes) for child in queries.children[q]]
            continue
        if inner:
            # descend the data's nodes; the best go first, so that the others meet a higher worst score
            below = np.asarray([c for n in nodes for c in (data.children[n] or [n])], np.int64)
            if len(below) > 64:
                up = bound(queries.at[q], queries.reach[q], data.at[below], data.reach[below], queries.norm[q], data.norm[below])
                below = below[np.argsort(up)]
                waiting += [(q, part) for part in np.array_split(below, -(-len(below) // 32))]
            else:
                waiting.append((q, below))
            continue
        for n in nodes[::-1]:
            worst = least[begin:end].min()
            if bound(queries.at[q], queries.reach[q], data.at[n : n + 1], data.reach[n : n + 1], queries.norm[q], data.norm[n : n + 1])[0] < worst:
                continue
            a, b = data.span[n]
            scores = scored(sides[0][begin:end], sides[1][a:b], exact)
            if seen is not None:
                seen.append(scores.size)
            hopeful = scores >= least[begin:end, None]
            for i in np.flatnonzero(hopeful.any(axis=1)):
                at = np.flatnonzero(hopeful[i])
                s = np.repeat(scores[i, at], ids.shape[1])
                t = ids[a + at].ravel()
                real = (t >= 0) & (t != query_ids[begin + i])
                s, t = np.concatenate([best.scores[begin + i], s[real]]), np.concatenate([best.ids[begin + i], t[real]])
                order = np.lexsort((t, ~s))[:k]
                best.scores[begin + i], best.ids[begin + i] = s[order], t[order]
                if s[order[-1]] != NONE:
                    least[begin + i] = max(least[begin + i], s[order[-1]])


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null where the vector has none, a null one or one that isn't finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: x.cast("double") * F.lit(float(scale))
    held = lambda x: F.when(F.abs(whole(x)) >= F.lit(2.0**62), F.raise_error(F.lit("a component of 2 ** 62 or more")).cast("bigint")).otherwise(F.floor(whole(x)))
    return F.when((F.size(vector) > 0) & fine, F.transform(vector, held))


def points(df: DataFrame, k: int) -> DataFrame:
    """(v, ids): each different vector with the k + 1 smallest of its ids.  Equal ones meet by parts of their ids first."""
    small = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    parts = df.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("part")).agg(small(F.collect_set("id")).alias("ids"))
    return parts.groupBy("v").agg(small(F.flatten(F.collect_list("ids"))).alias("ids"))


def _near(pivots: np.ndarray):
    @F.arrow_udf("int")
    def near(column: pa.Array) -> pa.Array:
        x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), "f8").reshape(len(column), -1)
        return pa.array(((pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T).argmin(axis=1).astype("int32"))

    return near


_BLOCKS = "block bigint, pivot int, tree binary"


def blocks(df: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """Rows (v, ids array<bigint>) in blocks of points that are near each other, about BLOCK points each."""
    named = df.withColumn("pivot", _near(pivots)(F.col("v"))).withColumn("h", F.xxhash64("v", "ids"))
    sizes = named.groupBy("pivot").agg(F.count("*").alias("size"))  # as many rows as pivots
    cut = F.ceil(F.col("size") / F.lit(BLOCK)).cast("bigint")
    named = named.join(F.broadcast(sizes), "pivot")
    named = named.withColumn("block", F.xxhash64("pivot", F.pmod(F.col("h"), cut)))

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = np.asarray(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64).reshape(table.num_rows, -1)
        lists = table.column("ids").to_pylist()
        order = sorted(range(len(lists)), key=lambda i: lists[i])
        ids = np.full((len(lists), width), -1, np.int64)
        for to, i in enumerate(order):
            ids[to, : len(lists[i])] = lists[i]
        columns = [[key[0].as_py()], [key[1].as_py()], [CoverTree(x[order], ids).pack()]]
        types = [pa.int64(), pa.int32(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "pivot", "tree"])

    return named.select("block", "pivot", "v", "ids").groupBy("block", "pivot").applyInArrow(packed, _BLOCKS)


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _meet(data: DataFrame, shared: Broadcast, k: int, near: bool) -> DataFrame:
    """(query_id, vec_id, score) of each query's best k in each task: of data blocks of its own group, or of all others.

    shared: (pivot, packed tree, known k-th scores or None) of each query block of the round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, trees, kept = [], [], []
        for batch in batches:
            for pivot, packed in zip(batch.column("pivot").to_pylist(), batch.column("tree"), strict=True):
                if not trees:
                    for group, tree, floor in shared.value:
                        groups.append(group)
                        trees.append(CoverTree.unpack(tree))
                        kept.append(Best.of(len(trees[-1].points), k, floor))
                    centers, reach, norm = (np.stack([getattr(t, n)[0] for t in trees]) for n in ("at", "reach", "norm"))
                block = CoverTree.unpack(packed.as_py())
                # the roots of all query trees against the block's
                upper = bound(block.at[0], block.reach[0], centers, reach, block.norm[0], norm)
                for i in np.argsort(-upper):
                    if (groups[i] == pivot) == near and upper[i] >= kept[i].least.min():
                        search(trees[i], block, kept[i])
        for tree, own in zip(trees, kept, strict=True):
            real = own.scores != NONE
            if real.any():
                of = np.broadcast_to(tree.ids[:, :1], real.shape)
                yield pa.RecordBatch.from_arrays([pa.array(of[real]), pa.array(own.ids[real]), pa.array(own.scores[real])], names=["query_id", "vec_id", "score"])

    return data.select("pivot", "tree").mapInArrow(run, _FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score)."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(df: DataFrame, queries: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest scores among all other ids."""
    spark = df.sparkSession
    usable = df.select(F.col(vec_id).cast("bigint").alias("id"), integers(F.col(vector), scale).alias("v"), queries.alias("is_query")).filter("id IS NOT NULL AND v IS NOT NULL")
    lengths = usable.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    usable = stored(usable.filter(F.size("v") == lengths[0].dim))
    # pivots: a bounded sample of different vectors, each the furthest from those before
    sampled = usable.select("v", level(F.col("v"), 4).alias("level")).dropDuplicates(["v"]).orderBy(F.desc("level"), F.xxhash64("v")).limit(PIVOT_ROWS).collect()
    pool = np.asarray([r.v for r in sampled], "f8")
    chosen, far = [0], ((pool - pool[0]) ** 2).sum(axis=1)
    while len(chosen) < min(PIVOTS, len(pool)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((pool - pool[chosen[-1]]) ** 2).sum(axis=1))
    pivots = pool[chosen]
    data = stored(blocks(points(usable, k), pivots, k + 1))
    asked = usable.filter("is_query").select("v", F.array("id").alias("ids")).distinct()
    query = stored(blocks(asked, pivots, 1))
    rounds = max(1, -(-(query.agg(F.sum(F.length("tree")).alias("n")).first().n or 0) // ROUND_BYTES))
    out = f"{shared_folder(spark)}/corvane-{uuid.uuid4().hex}"
    spark.createDataFrame([], _FOUND).write.parquet(out)
    written(out)
    before = made()
    for turn in range(rounds):
        taken = query.filter(F.pmod(F.xxhash64("block"), F.lit(rounds)) == turn).select("pivot", "tree").collect()  # about ROUND_BYTES
        if not taken:
            continue
        first_blocks = spark.sparkContext.broadcast([(r.pivot, bytes(r.tree), None) for r in taken])
        groups = sorted({r.pivot for r in taken})
        found = stored(best(_meet(data.filter(F.col("pivot").isin(groups)), first_blocks, k, True), k))
        # the k-th scores so far, one for each query of the round
        known = found.filter(F.col("rank") == k).select("query_id", "score").toArrow()
        reached = dict(zip(known.column("query_id").to_pylist(), known.column("score").to_pylist(), strict=True))
        floors = [np.asarray([reached.get(i, -np.inf) for i in CoverTree.unpack(bytes(r.tree)).ids[:, 0].tolist()], "f8") for r in taken]
        later = spark.sparkContext.broadcast([(r.pivot, bytes(r.tree), f) for r, f in zip(taken, floors, strict=True)])
        every = found.select("query_id", "vec_id", "score").unionByName(_meet(data, later, k, False))
        best(every, k).drop("rank").write.mode("append").parquet(out)
        clear_stored(spark, before)
        first_blocks.destroy()
        later.destroy()
    # an id with several vectors may be a query of several rounds
    return best(spark.read.schema(_FOUND).parquet(out), k)
