"""Exact top-k inner products by dual-tree search (operator 6).

Vectors become integers, so scores are exact. The top of the data's tree is flat: at most CELLS centres, spread over a
bounded sample of the data (SAMPLE rows), deal every data row to the cell of its nearest centre, whose covering
radius is that of all its rows. A query first searches a part of the cell whose centre fits it best; its kth score
there is a floor. It then goes to those cells alone whose centre and radius allow a product above the floor. Large
cells are cut into parts of bounded size, the queries of a cell into groups.

In a part both sides are cover trees: a node holds the points within its covering radius of its centre, and its
children are a net of it (centres further apart than half that radius, every point within it). The trees are
descended together from both roots: a pair of a query node and a data node is pruned when the largest inner product
that their centres and radii allow is below the worst kth score (or floor) of the query node's points, else the
node with the larger radius is split. Pairs of leaves are scored in blocks of products. The k best of all parts are
merged; ties go to the smaller id.

Equal data vectors of a part are one point with its k + 1 smallest ids, which is exact: further copies cannot
be among the k best.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, on either side;
so do rows without an id; vectors of another length than the query's share no score with it (lengths without a
centre have one cell of no centre); rows that repeat id and vector are one row; a query never finds its own id;
fewer candidates than k give all of them; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, drop

#: Most centres, and rows of the sample that they are picked from; least rows that make a cell worth while, on average.
CELLS = 256
SAMPLE = 4096
CELL_ROWS = 1024
#: Rows of a part of a cell and of a group of queries, on average at most.
DATA_BLOCK = 4096
QUERY_BLOCK = 8192
#: Points of a data leaf, and queries that share one bound.
LEAF = 64
GROUP = 32


@dataclass
class Cover:
    centre: np.ndarray
    radius: float
    points: np.ndarray
    children: list["Cover"] = field(default_factory=list)


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, leaf: int = LEAF, radius: float | None = None) -> Cover:
    """A cover tree of the rows of x. Nodes of at most leaf points, or that a net at half the radius would cut into
    nearly as many children as points, are leaves' parents: they are cut into runs by distance from the centre."""
    points = np.arange(len(x)) if points is None else points
    own = x[points]
    middle = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmin()]
    far = np.sqrt(((own - middle) ** 2).sum(axis=1))
    node = Cover(middle, float(far.max(initial=0.0)), points)
    if len(points) <= leaf or node.radius == 0:
        return node
    limit = node.radius / 2
    free = np.arange(len(points))
    nets: list[np.ndarray] = []
    singles: list[int] = []
    while len(free):
        near = ((own[free] - own[free[0]]) ** 2).sum(axis=1) <= limit * limit
        inside = free[near]
        if len(inside) > 1:
            nets.append(inside)
        else:
            singles.append(int(inside[0]))
        if len(singles) > 2 * leaf and len(singles) > 4 * len(nets):
            # no net at this scale: the points are about equally far from each other
            singles += free[~near].tolist()
            break
        free = free[~near]
    node.children = [cover_tree(x, points[n], leaf) for n in nets]
    if singles:
        s = np.array(singles)
        s = s[np.argsort(far[s], kind="stable")]
        for lo in range(0, len(s), leaf):
            part = own[s[lo : lo + leaf]]
            centre = part.mean(axis=0)
            node.children.append(Cover(centre, float(np.sqrt(((part - centre) ** 2).sum(axis=1)).max()), points[s[lo : lo + leaf]]))
    return node


def bound(q: Cover, p: Cover) -> float:
    """The greatest inner product of a point of q and a point of p."""
    far_q, far_p = float(np.sqrt(q.centre @ q.centre)) + q.radius, float(np.sqrt(p.centre @ p.centre)) + p.radius
    return float(q.centre @ p.centre) + q.radius * (far_p - p.radius) + p.radius * (far_q - q.radius) + q.radius * p.radius + 1e-9 * far_q * far_p + 1e-6


def search(data: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray | None = None, seen: dict[str, int] | None = None) -> list[list[tuple[int, int]]]:
    """For each query the k best (-score, id) that reach its floor, ties to smaller ids. ids: the ids of each distinct
    data row, sorted. seen: gets numbers of node pairs: pruned, pruned with an inner query node, scored."""
    best: list[list[tuple[int, int]]] = [[] for _ in own]
    if not len(own) or not len(data):
        return best
    floor = np.full(len(own), -np.inf) if floors is None else floors.astype(float)
    real, there = queries.astype(float), data.astype(float)
    # products of whole numbers are exact in floating point while they stay below 2 ** 53
    small = np.abs(real).max() * np.abs(there).max() * data.shape[1] < 2.0**53
    asked, held = (real, there) if small else (queries.astype(np.int64), data.astype(np.int64))
    first = np.array([i[0] for i in ids], np.int64)
    alone = np.array([len(i) == 1 for i in ids])
    counts = seen if seen is not None else {}

    def score(group: np.ndarray, points: np.ndarray) -> None:
        products = asked[group] @ held[points].T
        for row, qi in zip(products, group.tolist()):
            good = np.flatnonzero(row >= floor[qi])
            if not len(good):
                continue
            if len(good) > k + 1:  # the best rows, and every row as good as the last of them
                good = good[row[good] >= np.partition(row[good], -(k + 1))[-(k + 1)]]
            found = best[qi]
            for j in good.tolist():
                s, p = int(row[j]), int(points[j])
                if alone[p]:
                    if first[p] != own[qi]:
                        found.append((-s, int(first[p])))
                else:
                    found += [(-s, i) for i in ids[p].tolist() if i != own[qi]][:k]
            found.sort()
            del found[k:]
            if len(found) == k:
                floor[qi] = max(floor[qi], -found[-1][0])

    todo = [(cover_tree(real, leaf=GROUP), cover_tree(there))]
    todo = [(bound(*todo[0]), *todo[0])]
    while todo:
        limit, q, p = todo.pop()
        if limit < floor[q.points].min():
            counts["pruned"] = counts.get("pruned", 0) + 1
            counts["inner"] = counts.get("inner", 0) + bool(q.children)
            continue
        if not q.children and not p.children:
            counts["scored"] = counts.get("scored", 0) + 1
            score(q.points, p.points)
            continue
        if p.children and (not q.children or p.radius >= q.radius):
            pairs = [(bound(q, c), q, c) for c in p.children]
        else:
            pairs = [(bound(c, p), c, p) for c in q.children]
        pairs.sort(key=lambda x: x[0])  # the most promising pair is taken from the end
        todo += pairs
    return best


@dataclass
class Cells:
    """Centres by vector length, and the cell number of each; lengths without a centre have cell -1."""

    centres: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, sample: list[list[int]], most: int) -> "Cells":
        """At most `most` centres, each the row of the sample that is furthest from those before."""
        rows = sorted(set(map(tuple, sample)))
        sizes = sorted({len(r) for r in rows}, key=lambda n: -sum(len(r) == n for r in rows))[:most]
        centres, number = {}, 0
        for n in sizes:
            x = np.array([r for r in rows if len(r) == n], float)
            share = max(1, (most - len(sizes)) * len(x) // max(len(rows), 1) + 1)
            picked, near = [0], ((x - x[0]) ** 2).sum(axis=1)
            while len(picked) < min(share, len(x)) and near.max() > 0:
                picked.append(int(near.argmax()))
                near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(axis=1))
            centres[n] = (x[picked], np.arange(number, number + len(picked)))
            number += len(picked)
        return cls(centres)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of the nearest centre of each row, and the distance."""
        if x.shape[1] not in self.centres:
            return np.full(len(x), -1), np.zeros(len(x))
        c, number = self.centres[x.shape[1]]
        at = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
        return number[at], np.sqrt(((x - c[at]) ** 2).sum(axis=1))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of a list column, for each length of the lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    sizes, begin, flat = np.diff(offsets), offsets[:-1] - offsets[0], np.asarray(column.flatten(), dtype=np.int64)
    for size in np.unique(sizes):
        here = np.flatnonzero(sizes == size)
        yield here, flat[begin[here][:, None] + np.arange(size)]


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """The k best rows of vectors for each row of queries: query_id, rank, vec_id, score (integer inner product of
    floor(scale * x))."""
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        fine = F.size(v) > 0
        fine &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        kept = df.where(F.col(id_col).isNotNull() & v.isNotNull()).where(fine)
        return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")).distinct()

    files: list[str] = []
    data = cut(whole(vectors), files)
    n = data.count()
    sample = [r["v"] for r in data.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()] if n else []
    cells = Cells.of(sample, min(CELLS, max(1, n // CELL_ROWS)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for here, x in _by_length(batch.column("v")):
                cell[here], far[here] = cells.nearest(x.astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far), *batch.columns], names=["cell", "far", "id", "v"])

    dealt = cut(data.mapInArrow(deal, "cell int, far double, id long, v array<long>"), files)
    known = {r["cell"]: (r["r"], max(1, -(-r["n"] // DATA_BLOCK))) for r in dealt.groupBy("cell").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect()}  # at most CELLS + 1
    radius = {c: r for c, (r, _) in known.items()}
    table = spark.createDataFrame([(c, m) for c, (_, m) in known.items()], "cell int, parts int")
    dealt = dealt.join(F.broadcast(table), "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "parts", "id", "v")

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.full(batch.num_rows, -1, np.int32)
            for here, x in _by_length(batch.column("v")):
                if x.shape[1] in cells.centres:
                    c, number = cells.centres[x.shape[1]]
                    home[here] = number[(x @ c.T).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(home), *batch.columns], names=["home", "id", "v"])

    asked = cut(whole(queries).mapInArrow(homes, "home int, id long, v array<long>"), files)
    found = _searched(dealt.where("part = 0"), asked.select(F.col("home").alias("cell"), F.lit(0).alias("part"), "id", "v", F.lit(float("-inf")).alias("floor")), k, files)
    near = cut(found, files)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = _merged(near).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that can hold a product at or above the floor."""
        for batch in batches:
            floor, out = batch.column("floor").to_numpy(zero_copy_only=False), [[]] * batch.num_rows
            for here, x in _by_length(batch.column("v")):
                if x.shape[1] not in cells.centres:
                    for i in here.tolist():
                        out[i] = [-1]
                    continue
                c, number = cells.centres[x.shape[1]]
                r = np.array([radius.get(int(i), -1.0) for i in number])
                length = np.sqrt((x.astype(float) ** 2).sum(axis=1))[:, None]
                size = length * (np.sqrt((c * c).sum(axis=1)) + r)
                good = (x @ c.T + length * r + 1e-9 * size + 1e-6 >= floor[here][:, None]) & (r >= 0)
                for i, row in zip(here.tolist(), good):
                    out[i] = number[row].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=["home", "id", "v", "floor", "cells"])

    wide = asked.join(floors, "id", "left").select("home", "id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    wide = wide.mapInArrow(reach, "home int, id long, v array<long>, floor double, cells array<int>")
    wide = wide.select("home", "id", "v", "floor", F.explode("cells").alias("cell")).join(F.broadcast(table), "cell")
    wide = wide.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("cell <> home or part > 0").select("cell", "part", "id", "v", "floor")
    found = _merged(near.unionAll(_searched(dealt, cut(wide, files), k, files)))
    out = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    drop(spark, files)
    return out


def _merged(found: DataFrame) -> DataFrame:
    """An id that comes with several vectors keeps its best score."""
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def _searched(data: DataFrame, asked: DataFrame, k: int, files: list[str]) -> DataFrame:
    """(query_id, vec_id, score): the k best rows of each part for the queries (cell, part, id, v, floor) that come to it."""
    groups = asked.groupBy("cell", "part").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / QUERY_BLOCK)).cast("int").alias("groups"))
    # a part meets each group of its queries; parts without a query stay out
    left = data.join(groups, ["cell", "part"]).select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(False).alias("asked"), "id", "v", F.lit(None).cast("double").alias("floor"))
    right = asked.join(groups, ["cell", "part"]).select("cell", "part", F.pmod(F.xxhash64("id"), "groups").cast("int").alias("g"), F.lit(True).alias("asked"), "id", "v", "floor")

    def run(t: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        asks, ids, floor = t.column("asked").to_numpy(), t.column("id").to_numpy(), t.column("floor").to_numpy()
        for here, x in _by_length(t.column("v")):
            is_query = asks[here]
            if is_query.all() or not is_query.any():
                continue
            points, which = np.unique(x[~is_query], axis=0, return_inverse=True)
            order = np.lexsort((ids[here][~is_query], which.ravel()))
            grouped = np.split(ids[here][~is_query][order], np.flatnonzero(np.diff(which.ravel()[order])) + 1)
            own = ids[here][is_query]
            for q, found in zip(own.tolist(), search(points, [np.unique(g)[: k + 1] for g in grouped], x[is_query], own, k, floor[here][is_query])):
                rows += [(q, i, -s) for s, i in found]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return left.unionAll(right).groupBy("cell", "part", "g").applyInArrow(run, "query_id long, vec_id long, score long")
