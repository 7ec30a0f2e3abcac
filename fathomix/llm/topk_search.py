"""Operator 3: exact top-k inner products by dual-tree cover-tree search.

The top levels of one cover tree, built over a bounded sample, cut space into cells;
every vector goes to the cell of its nearest centre, and a cell's radius is measured
over all of its vectors. A cell of many vectors is cut into blocks. First each query
meets one block of the cell with the best bound, which gives it a kth score; then it
goes to the blocks of exactly those cells whose bound reaches that score. Where a block
meets its queries both sides are indexed by a cover tree: a node has one of its points
as centre, a covering radius, and children around centres that lie further apart than
the scale of the next level. Pairs of nodes are visited from the roots down; a pair is
pruned when the centres' inner product plus what the covering radii allow is below the
worst kth score among the node's queries. What remains is scored leaf by leaf, best
bound first. The best of all blocks are merged by query.

Nodes have FANOUT children at most, so centres of one level may lie closer than its
scale; all radii are measured, so bounds hold regardless. Scores are exact: components
are integers, and double arithmetic is used only where no sum can exceed 2**53. A block
with wider integers is scored in full by Python's, without a tree.

Defined results: a vector that is null or holds a null or non-finite component takes
no part, nor does a null id; vectors of unlike length count as filled up with zeros;
rows with the query's own id are no candidates, other repeated rows are each their
own; of rows that share a query id the smallest vector is the query; ties go to the
smaller id; an empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomix.llm.common import materialize

#: Points a leaf of data and one of queries holds, and children a node has, at most: radii
#: are measured, so bounds stay true. Queries are few and spread, so their leaves are small.
LEAF, QUERY_LEAF, FANOUT = 64, 32, 24
#: Points that are scored together, about.
BATCH = 2_048
#: Rows of a block of data, and queries that meet it in one task, about.
DATA_ROWS, QUERY_ROWS = 4_096, 2_048
#: Cells at most, and vectors a cell that are sampled to place the centres.
MOST_CELLS, CELL_SAMPLE = 1_024, 8
_SAFE = 2.0**52


class CoverTree:
    """Nodes as parallel lists; a leaf owns a slice of `order`."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> None:
        self.points, self.leaf, self.fanout = points, leaf, fanout
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray | None] = []
        if len(points):
            self._build(np.arange(len(points)), 0)

    def _distances(self, idx: np.ndarray, center: int) -> np.ndarray:
        diff = self.points[idx] - self.points[center]
        return np.sqrt(np.einsum("ij,ij->i", diff, diff))

    def _build(self, idx: np.ndarray, center: int) -> int:
        node = len(self.center)
        away = self._distances(idx, center)
        radius = float(away.max())
        self.center.append(center)
        self.radius.append(radius)
        self.children.append([])
        self.members.append(None)
        if len(idx) <= self.leaf or radius == 0.0:
            self.members[node] = idx
            return node
        # The next level: centres more than half the radius apart, each point with its nearest.
        centers, nearest, owner = [center], away, np.zeros(len(idx), np.int64)
        while len(centers) < self.fanout:
            far = int(nearest.argmax())
            if nearest[far] <= radius / 2:
                break
            centers.append(int(idx[far]))
            d = self._distances(idx, centers[-1])
            closer = d < nearest
            owner[closer] = len(centers) - 1
            nearest = np.minimum(nearest, d)
        for k, c in enumerate(centers):
            mine = idx[owner == k]
            if len(mine):
                self.children[node].append(self._build(mine, c))
        return node


class DualSearch:
    """floors: of each query, a score that its kth best reaches already, or minus infinity."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> None:
        self.q, self.d = CoverTree(queries, QUERY_LEAF), CoverTree(data)
        self.query_ids, self.data_ids, self.k = query_ids, data_ids, k
        self.q_norm = np.sqrt((queries**2).sum(axis=1))
        self.d_norm = np.sqrt((data**2).sum(axis=1))
        self.best = np.full((len(queries), k), -np.inf)
        if floors is not None:
            self.best[:] = floors[:, None]
        self.best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.q_rows = self._all_members(self.q)
        self.pruned = self.compared = 0

    @staticmethod
    def _all_members(tree: CoverTree) -> list[np.ndarray]:
        rows: list[np.ndarray] = [np.empty(0, np.int64)] * len(tree.center)
        for node in reversed(range(len(tree.center))):  # children are numbered after their parent
            rows[node] = tree.members[node] if tree.members[node] is not None else np.concatenate([rows[c] for c in tree.children[node]])
        return rows

    def bounds(self, a: int, nodes: np.ndarray) -> np.ndarray:
        """No inner product of a query below a and a point below a node exceeds the node's bound."""
        qc, ra = self.q.center[a], self.q.radius[a]
        centers, rb = self.d_centers[nodes], self.d_radii[nodes]
        value = self.d.points[centers] @ self.q.points[qc] + ra * self.d_norm[centers] + rb * self.q_norm[qc] + ra * rb
        return value + 1e-9 * np.abs(value) + 1e-6

    def run(self) -> None:
        if not len(self.q.center) or not len(self.d.center):
            return
        self.d_centers, self.d_radii = np.array(self.d.center), np.array(self.d.radius)
        self.d_inner = np.array([bool(c) for c in self.d.children])
        leaves = np.flatnonzero(~self.d_inner)
        # A first leaf of data for every leaf of queries gives kth scores to prune with from the root on.
        begun: dict[int, int] = {}
        for a in (n for n, c in enumerate(self.q.children) if not c):
            begun[a] = int(leaves[self.bounds(a, leaves).argmax()])
            self._score(self.q.members[a], self.d.members[begun[a]])
        stack = [(0, np.array([0]))]
        while stack:
            a, nodes = stack.pop()
            rows, is_leaf = self.q_rows[a], not self.q.children[a]
            # Nodes of data as fine as the query node are kept; coarser ones give way to their children.
            ready = []
            while len(nodes):
                keep = self.bounds(a, nodes) >= self.best[rows, -1].min()
                self.pruned += int((~keep).sum())
                nodes = nodes[keep]
                coarse = self.d_inner[nodes] & (is_leaf | (self.d_radii[nodes] > self.q.radius[a]))
                ready.append(nodes[~coarse])
                nodes = np.array([c for n in nodes[coarse] for c in self.d.children[n]], np.int64)
            left = np.concatenate(ready) if ready else nodes
            if is_leaf:
                self._finish(rows, left[left != begun[a]])
            else:
                stack += [(c, left) for c in self.q.children[a]]

    def _finish(self, rows: np.ndarray, leaves: np.ndarray) -> None:
        """Scores leaves of data, best bound first and some together, while one can still help a query."""
        centers = self.d_centers[leaves]
        own = self.q.points[rows] @ self.d.points[centers].T + self.q_norm[rows][:, None] * self.d_radii[leaves]
        own += 1e-9 * np.abs(own) + 1e-6
        order = np.argsort(-own.max(axis=0)) if len(leaves) else leaves
        leaves, own = leaves[order], own[:, order]
        while len(leaves):
            helps = own >= self.best[rows, -1][:, None]
            useful = helps.any(axis=0)
            self.pruned += int((~useful).sum())
            leaves, own, helps = leaves[useful], own[:, useful], helps[:, useful]
            sizes = np.cumsum([len(self.d.members[n]) for n in leaves])
            n = int(np.searchsorted(sizes, BATCH)) + 1
            live = helps[:, :n].any(axis=1)
            if live.any():
                self._score(rows[live], np.concatenate([self.d.members[x] for x in leaves[:n]]))
            leaves, own = leaves[n:], own[:, n:]

    def _score(self, rows: np.ndarray, cols: np.ndarray) -> None:
        self.compared += len(rows) * len(cols)
        scores = self.q.points[rows] @ self.d.points[cols].T
        ids = np.broadcast_to(self.data_ids[cols], scores.shape)
        scores[self.query_ids[rows][:, None] == ids] = -np.inf
        live = (scores >= self.best[rows, -1][:, None]).any(axis=1)
        if not live.any():
            return
        rows, scores, ids = rows[live], scores[live], ids[live]
        if scores.shape[1] > 8 * self.k:
            # Only columns that are among a row's k best, ties included, are worth sorting.
            least = np.maximum(np.partition(scores, -self.k, axis=1)[:, -self.k], self.best[rows, -1])
            some = (scores >= least[:, None]).any(axis=0)
            scores, ids = scores[:, some], ids[:, some]
        all_scores = np.concatenate([self.best[rows], scores], axis=1)
        all_ids = np.concatenate([self.best_ids[rows], ids], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.best[rows] = np.take_along_axis(all_scores, order, axis=1)
        self.best_ids[rows] = np.take_along_axis(all_ids, order, axis=1)


def search_block(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[list[int], list[int], list[int]]:
    """(query ids, data ids, scores) of each query's k best in the block that reach its floor; arrays of integers."""
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    if not len(queries) or not len(data):
        return out
    peak = max(int(np.abs(queries.astype(float)).max(initial=0)), 1) * max(int(np.abs(data.astype(float)).max(initial=0)), 1)
    if peak * max(1, queries.shape[1]) < _SAFE:
        search = DualSearch(queries.astype(float), query_ids, data.astype(float), data_ids, k, floors)
        search.run()
        row, place = np.nonzero((search.best > -math.inf) & (search.best_ids < np.iinfo(np.int64).max))
        return query_ids[row].tolist(), search.best_ids[row, place].tolist(), search.best[row, place].astype(np.int64).tolist()
    wide = data.astype(object)
    for vector, q in zip(queries.astype(object), query_ids):
        scores = wide @ vector
        found = sorted((-s, int(i)) for s, i in zip(scores, data_ids) if i != q)[:k]
        for s, i in found:
            out[0].append(int(q)), out[1].append(i), out[2].append(max(-(2**63), min(2**63 - 1, -s)))
    return out


def whole_vectors(column: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as array<bigint>; null for vectors that take no part."""
    values = F.transform(column, lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(column.isNotNull() & ~bad, F.transform(values, lambda x: F.floor(x * scale)))


def _matrix(rows, width: int, kind=np.int64) -> np.ndarray:
    """Vectors as rows, cut or filled up with zeros to a width."""
    out = np.zeros((len(rows), width), kind)
    for i, v in enumerate(rows):
        out[i, : min(width, len(v))] = v[:width]
    return out


class Cells:
    """Centres of the top levels of a cover tree, and what is known of the vectors around each."""

    def __init__(self, sample: np.ndarray, most: int) -> None:
        width = sample.shape[1] if len(sample) else 0
        self.centers = np.zeros((1, width))
        if len(sample):
            self.centers = self._top(CoverTree(sample, 1, min(FANOUT, max(2, most))), most)
        self.norms = np.sqrt((self.centers**2).sum(axis=1))
        self.radii, self.first, self.blocks = np.zeros(len(self.centers)), np.zeros(len(self.centers), np.int64), np.ones(len(self.centers), np.int64)

    @staticmethod
    def _top(tree: CoverTree, most: int) -> np.ndarray:
        """The centres of the tree's widest nodes: the widest gives way to its children while there is room."""
        import heapq

        heap = [(-tree.radius[0], 0)]
        while True:
            children = tree.children[heap[0][1]]
            if not children or len(heap) - 1 + len(children) > most:
                break
            heapq.heappop(heap)
            for c in children:
                heapq.heappush(heap, (-tree.radius[c] if tree.children[c] else 0.0, c))
        return tree.points[[tree.center[n] for _, n in heap]]

    @property
    def width(self) -> int:
        return self.centers.shape[1]

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        return ((self.centers**2).sum(axis=1)[None, :] - 2 * vectors @ self.centers.T).argmin(axis=1)

    def measured(self, radii: np.ndarray, counts: np.ndarray, rows: int) -> None:
        """Takes in the radii and sizes of cells and numbers the blocks they are cut into."""
        self.radii = np.where(counts > 0, radii, -np.inf)
        self.blocks = -(-counts // rows)
        self.first = np.cumsum(self.blocks) - self.blocks

    def bounds(self, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """No inner product of a query and a vector of a cell exceeds the cell's bound; minus infinity for empty cells."""
        reach = norms[:, None] * np.maximum(self.radii, 0.0)[None, :]
        value = queries @ self.centers.T + reach
        value += 1e-9 * (norms[:, None] * self.norms[None, :] + reach) + 1e-6
        return np.where(np.isfinite(self.radii)[None, :], value, -np.inf)


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def celled(data: DataFrame, n: int) -> tuple[DataFrame, Cells]:
    """data (vec_id, vector) with its block, written, and the cells."""
    most = max(1, min(MOST_CELLS, math.ceil(n / DATA_ROWS)))
    wanted = CELL_SAMPLE * most
    share = min(1.0, 2 * wanted / max(1, n))
    some = data.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else data
    sample = [r["vector"] for r in some.select("vector").limit(wanted).collect()]  # CELL_SAMPLE * MOST_CELLS vectors at most
    width = max(map(len, sample), default=0)
    cells = Cells(_matrix(sample, width, float), most)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _lists(batch.column("vector"))
            whole = _matrix(vectors, cells.width, float)
            cell = cells.nearest(whole) if len(whole) else np.empty(0, np.int64)
            beyond = np.array([float((v[cells.width :].astype(float) ** 2).sum()) for v in vectors])
            away = np.sqrt(((whole - cells.centers[cell]) ** 2).sum(axis=1) + beyond)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cell, pa.int32()), pa.array(away, pa.float64())], names=["vec_id", "vector", "cell", "away"])

    # The salt is written with the row, so that a block's rows stay the same; it also parts rows that are wholly equal.
    placed = data.select("vec_id", "vector").mapInArrow(place, "vec_id long, vector array<bigint>, cell int, away double").withColumn("salt", F.monotonically_increasing_id())
    placed = materialize(placed, "cells")
    counts, radii = np.zeros(len(cells.centers), np.int64), np.zeros(len(cells.centers))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():  # MOST_CELLS rows at most
        counts[r["cell"]], radii[r["cell"]] = r["n"], r["away"]
    cells.measured(radii * (1 + 1e-9) + 1e-9, counts, DATA_ROWS)
    first, blocks = (F.get(F.split(F.lit(",".join(map(str, x.tolist()))), ",").cast("array<bigint>"), F.col("cell")) for x in (cells.first, cells.blocks))
    return placed.select("vec_id", "vector", (first + F.pmod("salt", blocks)).cast("int").alias("block")), cells


def met(asked: DataFrame, cells: Cells, chosen: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(vec_id, vector, floor, block): of queries (vec_id, vector, floor) the blocks that each must meet.

    chosen gets the ids, floors and bounds of a batch and gives the places of its queries, and the block each meets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                vectors = _lists(batch.column("vector"))
                norms = np.sqrt(np.array([float((v.astype(float) ** 2).sum()) for v in vectors]))
                bounds = cells.bounds(_matrix(vectors, cells.width, float), norms)
                for rows, blocks in chosen(batch.column("vec_id").to_numpy(), batch.column("floor").to_numpy(), bounds):
                    taken = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in ("vec_id", "vector", "floor")), pa.array(blocks, pa.int32())], names=["vec_id", "vector", "floor", "block"])

    return asked.select("vec_id", "vector", "floor").mapInArrow(run, "vec_id long, vector array<bigint>, floor double, block int")


def best_block(cells: Cells) -> Callable:
    """The first block a query meets: one of the cell with its highest bound."""

    def chosen(ids: np.ndarray, floors: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cell = bounds.argmax(axis=1)
        yield np.arange(len(ids)), cells.first[cell] + ids % np.maximum(cells.blocks[cell], 1)

    return chosen


def other_blocks(cells: Cells) -> Callable:
    """All blocks but the first of the cells whose bound reaches the query's floor."""
    first = best_block(cells)

    def chosen(ids: np.ndarray, floors: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ((_, begun),) = first(ids, floors, bounds)
        row, cell = np.nonzero((bounds >= floors[:, None]) & (cells.blocks > 0)[None, :])
        for nth in range(int(cells.blocks.max(initial=0))):
            has = cells.blocks[cell] > nth
            block = cells.first[cell[has]] + nth
            new = block != begun[row[has]]
            yield row[has][new], block[new]

    return chosen


def searched(pairs: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each query and block in pairs, the k best that reach the query's floor.

    The queries of a block are cut into chunks, and the block goes to each of them.
    """
    counts = {r["block"]: r["count"] for r in pairs.groupBy("block").count().collect()}  # a row a block
    chunks = [0] * (max(counts, default=0) + 1)
    for block, n in counts.items():
        chunks[block] = -(-n // QUERY_ROWS)
    of_block = F.coalesce(F.get(F.split(F.lit(",".join(map(str, chunks))), ",").cast("array<int>"), F.col("block")), F.lit(0))
    keys, tasks = ["block", "chunk"], max(1, min(4_096, 2 * sum(chunks)))
    left = pairs.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), of_block).cast("int")).repartition(tasks, *keys)
    right = data.withColumn("chunk", F.explode(F.when(of_block > 0, F.sequence(F.lit(0), of_block - 1)))).repartition(tasks, *keys)

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        width = max([0, *map(len, a["vector"]), *map(len, b["vector"])])
        found = search_block(_matrix(a["vector"], width), a["vec_id"].to_numpy(np.int64), _matrix(b["vector"], width), b["vec_id"].to_numpy(np.int64), k, a["floor"].to_numpy(float))
        return pd.DataFrame({"query_id": np.array(found[0], np.int64), "vec_id": np.array(found[1], np.int64), "score": np.array(found[2], np.int64)})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products.

    Both sides: (vec_id long, vector array<bigint>). A query meets the blocks that can
    still hold one of its k best; only the k best of a block go on.
    """
    data = vectors.where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "vector")
    asked = queries.where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocked, cells = celled(data, data.count())
    asked = materialize(asked.withColumn("floor", F.lit(float("-inf"))), "queries")
    first = materialize(searched(met(asked, cells, best_block(cells)), blocked, k), "first-blocks")
    kth = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("least"), F.count("*").alias("n"))
    floor = F.coalesce(F.when(F.col("n") >= k, F.col("least").cast("double")), F.lit(float("-inf")))
    floored = materialize(asked.drop("floor").join(kth, "vec_id", "left").select("vec_id", "vector", floor.alias("floor")), "floors")
    found = first.unionByName(searched(met(floored, cells, other_blocks(cells)), blocked, k))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Rows whose vec_id is divisible by every, against all rows."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole_vectors(F.col("embedding")).alias("vector"))
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
