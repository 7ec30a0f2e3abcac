"""Connected components of an edge table, in passes of one shuffle and no join.

Every node is owned by one of a fixed number of tasks, by hash. A task joins the
edges that it holds and says of each node that is not the smallest of its local
component which one is: to the node's owner. It also asks the owner of each such
smallest node for a smaller one, and a task answers with the smallest node that it
knows. Answers double the distance that a node sees, so passes grow with the
logarithm of a component's diameter.

A task speaks of a node, and asks about it, once a pass, so the owner of a node of
any number of edges gets at most one row of each kind from each task: no key is
heavy. A pass is written to the shared folder and reread, so lineage stays short;
the work ends when a pass changes nothing, which a count and a sum of hashes tell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fathomix.llm.common import materialize

#: Edges of a task, about: at least, where there are few, and at most.
FEW_EDGES, TASK_EDGES = 2_000, 500_000
#: Kinds of rows: of a and the smallest node b of its component; of a, which is the smallest; a question about a by task b.
EDGE, ROOT, QUESTION = 0, 1, 2
_ROWS = "at int, kind int, a long, b long"


def owner(nodes: np.ndarray) -> np.ndarray:
    """A hash of each node, not negative; modulo the number of tasks it is the owner."""
    x = nodes.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(33)).astype(np.int32)


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), ascending, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    one, other = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(one):
        # Roots of edges that still lead elsewhere hang below their smallest neighbour.
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while (root[root] != root).any():
            root = root[root]
        one, other = root[one], root[other]
        apart = one != other
        one, other = one[apart], other[apart]
    return nodes, nodes[root]


def _rows(at: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"at": at.astype(np.int32), "kind": np.full(len(a), kind, np.int32), "a": a, "b": b})


def _shrink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges as they come, TASK_EDGES at a time: to each node's owner its smallest node."""
    held: list[pd.DataFrame] = []

    def flush() -> pd.DataFrame:
        frame = pd.concat(held)
        held.clear()
        nodes, root = smallest(frame["u"].to_numpy(), frame["v"].to_numpy())
        away = nodes != root
        return _rows(owner(nodes[away]), EDGE, nodes[away], root[away])

    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= TASK_EDGES:
            yield flush()
    if held:
        yield flush()


def _pass(tasks: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [frame for frame in frames if len(frame)]
        if not held:
            return
        frame = pd.concat(held, ignore_index=True)
        me = int(frame["at"].iat[0]) % tasks
        edges = frame[frame["kind"] == EDGE]
        asked = frame[frame["kind"] == QUESTION]
        # Nodes that are only asked about are here as edges to themselves.
        x, by = asked["a"].to_numpy(), asked["b"].to_numpy()
        nodes, root = smallest(np.concatenate([edges["a"].to_numpy(), x]), np.concatenate([edges["b"].to_numpy(), x]))
        away = nodes != root
        yield _rows(owner(nodes[away]), EDGE, nodes[away], root[away])
        tops = np.unique(root[away])
        yield _rows(owner(tops), QUESTION, tops, np.full(len(tops), me, np.int64))
        known = root[np.searchsorted(nodes, x)]
        lower = known != x
        yield _rows(by[lower], EDGE, x[lower], known[lower])
        own = np.unique(x[~lower])
        yield _rows(owner(own), ROOT, own, own)

    return run


def _mark(rows: DataFrame) -> tuple:
    row = rows.agg(F.count("*"), F.sum(F.xxhash64("at", "kind", "a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame, find: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """(node, root) of every node of edges (u, v); the root is the component's smallest node.

    find: makes the edges from the rows of the first argument. It runs in the worker that
    shrinks them; as a mapInPandas before, it would hold a second worker a task.
    """
    spark = edges.sparkSession
    made = edges.mapInPandas(lambda frames: _shrink(find(frames)), _ROWS) if find else edges.where("u <> v").mapInPandas(_shrink, _ROWS)
    rows = materialize(made, "edges")
    mark = _mark(rows)
    tasks = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-mark[0] // FEW_EDGES)), -(-mark[0] // TASK_EDGES))
    while mark[0]:
        dealt = rows.where(F.col("kind") != ROOT).repartitionById(tasks, F.pmod("at", F.lit(tasks)).cast("int"))
        rows = materialize(dealt.mapInPandas(_pass(tasks), _ROWS), "edges")
        now = _mark(rows)
        if now == mark:
            break
        mark = now
    return rows.where(F.col("kind") != QUESTION).select(F.col("a").alias("node"), F.col("b").alias("root"))
