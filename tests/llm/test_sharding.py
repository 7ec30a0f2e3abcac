import zlib

from fathomix.llm import sharding as S

COLUMNS = ("doc_id", "size", "text_crc32", "shard", "slot")


def check(df, rows, shards):
    got = S.assign_shards(df, shards).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    assert {(r.law, r.grown_shard) for r in got} <= {("bytes", None)}
    by_text, slots, loads = {}, {}, [0] * shards
    for r in got:
        by_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r.size
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, loads


def test_lpt():
    sizes = [(7, "a"), (6, "b"), (5, "c"), (4, "d"), (4, "e"), (3, "f")]
    out = S.lpt(sizes, 3)
    loads = [sum(s for s, u in sizes if out[u] == k) for k in range(3)]
    assert sorted(loads) == [9, 10, 10]
    assert S.lpt([], 4) == {}


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 8)
    rows = [(i, f"text {i} " + "x" * (i * 37 % 101)) for i in range(400)]
    rows += [(1000 + i, "a copy") for i in range(150)] + [(2000, None), (2001, ""), (None, "null id"), (None, None), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    got, loads = check(df, rows, 4)
    groups = {}
    for _, t in rows:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 1
    assert max(loads) - min(loads) <= max(groups.values())
    again, _ = check(df.repartition(5), rows, 4)
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_one_row_many_times(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 8)
    monkeypatch.setattr(S, "TIMES", 7)
    rows = [(1, "the same row")] * 200 + [(i, f"own {i}") for i in range(150)] + [(None, "no id")] * 50
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 3)


def test_spread_is_near_that_of_plain_scheduling(spark):
    """Every group scheduled by itself, against light ones pooled in units: both end within a few bytes of each other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    groups = {}
    for r in docs.select("text").collect():
        groups[r.text or ""] = groups.get(r.text or "", 0) + len((r.text or "").encode()) + 1
    plain = [0] * 16
    for text, shard in S.lpt([(n, t) for t, n in groups.items()], 16).items():
        plain[shard] += groups[text]
    loads = {r.shard: r.bytes for r in S.assign_shards(docs, 16).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "bytes").collect()}
    assert sum(loads.values()) == sum(plain) and max(loads.values()) <= max(plain) + 0.005 * sum(plain) / 16


def test_light_groups_share_units(spark, monkeypatch):
    monkeypatch.setattr(S, "FINE", 4)
    rows = [(i, f"text {i}") for i in range(2000)]
    _, loads = check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 8)
    assert max(loads) - min(loads) <= 0.02 * sum(loads) / 8 + 20


def test_empty(spark):
    assert S.assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sample_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()], 16)
