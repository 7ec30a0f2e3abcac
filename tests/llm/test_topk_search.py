import math

import numpy as np
import pytest

from fathomix.llm import topk_search as T


def brute(rows, every, k):
    whole = {}
    keep = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        keep.append((i, [math.floor(256 * np.float32(x).astype(float)) for x in v]))
    for i, v in keep:
        if i % every == 0:
            whole[i] = min(whole.get(i, v), v)
    out = []
    for q, v in whole.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in keep if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def got(df, every=50, k=5):
    return sorted(tuple(r) for r in T.search_embeddings(df, every, k).collect())


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(T, "DATA_ROWS", 60)
    monkeypatch.setattr(T, "QUERY_ROWS", 7)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(80)]  # a hot vector: ties
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (7, rows[7][1]), (50, rows[3][1]), (504, [2.0]), (550, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    assert got(df) == brute(rows, 50, 5)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert got(df) == [(0, 1, 1, 131072)]
    assert got(df.limit(0)) == []


def test_wide_integers():
    big = np.array([[2**40, 1], [2**40 + 1, 0]], np.int64)
    out = T.search_block(big[:1], np.array([0]), big, np.array([0, 1]), 5)
    assert out == ([0], [1], [min(2**63 - 1, 2**40 * (2**40 + 1))])


@pytest.mark.parametrize("seed", range(6))
def test_tree_and_pruning(seed):
    rng = np.random.default_rng(seed)
    centers = rng.integers(-200, 200, (12, 5))
    data = (centers[rng.integers(0, 12, 2000)] + rng.integers(-3, 4, (2000, 5))).astype(np.int64)
    tree = T.CoverTree(data.astype(float))
    for node, center in enumerate(tree.center):
        if tree.members[node] is not None:
            away = np.sqrt(((data[tree.members[node]] - data[center]) ** 2).sum(axis=1))
            assert away.max() <= tree.radius[node] + 1e-9
    ids = np.arange(2000)
    search = T.DualSearch(data[::40].astype(float), ids[::40], data.astype(float), ids, 5)
    search.run()
    scores = data[::40] @ data.T
    for row, q in enumerate(ids[::40]):
        want = sorted((-s, i) for i, s in enumerate(scores[row]) if i != q)[:5]
        assert [(-s, i) for s, i in zip(search.best[row], search.best_ids[row])] == want
    assert search.pruned and search.compared < 0.5 * 50 * 2000


def test_blocks_of_far_cells_are_skipped(spark, monkeypatch):
    """On clustered vectors a query meets few blocks; what it meets is counted, and the result is that of brute force."""
    monkeypatch.setattr(T, "DATA_ROWS", 100)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 8)) * 20
    rows = [(i, (centers[i % 30] + rng.normal(size=8) * 0.05).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    met, blocks = [], []
    real = T.searched

    def counted(pairs, data, k):
        met.append(pairs.count())
        blocks.append(data.select("block").distinct().count())
        return real(pairs, data, k)

    monkeypatch.setattr(T, "searched", counted)
    assert got(df) == brute(rows, 50, 5)
    assert blocks[0] >= 25 and met[0] == 60 and met[1] < 0.2 * 60 * blocks[0]


def test_many_queries_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(T, "DATA_ROWS", 40)
    monkeypatch.setattr(T, "QUERY_ROWS", 5)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).round(2).tolist()) for i in range(150)] + [(i, [0.5, 0.5, 0.5]) for i in range(150, 260)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(df, every=2, k=3) == brute(rows, 2, 3)


def test_vectors_longer_than_the_sample(spark):
    cells = T.Cells(np.array([[1.0, 2.0]]), 1)
    assert cells.width == 2 and T._matrix([np.array([1, 2, 3])], 2, float).tolist() == [[1.0, 2.0]]


def test_sample_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert got(df) == brute([(r.vec_id, r.embedding) for r in df.collect()], 50, 5)
