import random
import re

import pytest

from fathomix.llm import components as C


def brute(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((top(u), top(v)))
            root[b] = a
    return sorted((x, top(x)) for x in root)


def graphs():
    rng = random.Random(4)
    line = list(range(-300, 300))
    rng.shuffle(line)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(400)]
    return {
        "none": [],
        "loops": [(3, 3), (4, 4)],
        "shuffled line": list(zip(line, line[1:])),
        "line": [(i, i + 1) for i in range(300)],
        "hub": [(10_000, i) for i in range(500)] + [(i, i) for i in range(5)],
        "sparse": [(rng.choice(ids), rng.choice(ids)) for _ in range(260)],
        "repeated": [(1, 2), (2, 1), (1, 2), (5, 2), (-(2**63), 9), (2**63 - 1, 9)],
    }


@pytest.mark.parametrize("few", [2_000, 40])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW_EDGES", few)
    for name, edges in graphs().items():
        df = spark.createDataFrame(edges, "u long, v long").repartition(3)
        got = sorted((r.node, r.root) for r in C.connected(df).collect())
        assert got == brute(edges), name


def test_one_shuffle_a_pass(spark, monkeypatch):
    """A plan of many joins a pass took the driver's memory."""
    plans = []

    def seen(df, label, write=C.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(C, "materialize", seen)
    C.connected(spark.createDataFrame([(i, i + 1) for i in range(50)], "u long, v long")).collect()
    assert len(plans) > 1
    assert all(len(re.findall(r"\bExchange\b", p)) <= 1 and "Join" not in p and "Aggregate" not in p for p in plans)
