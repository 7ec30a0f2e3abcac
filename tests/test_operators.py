import io
import random
import sqlite3
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomix.operators import archives, indexing, knn, lexical, load, tables


QUERIES = ("the whst", '"of the"', "idiot OR moron", "the NOT of", "pathet*", "es la", "idiot OR moron NOT de", "(idiot OR moron) NOT de", "the AND of NOT on OR is", "of + the", "^the", "text : moron", "NEAR(of the, 1)", "NEAR(is on the, 3)", "the NOT (of OR on) NOT is", "th*", "t* NOT the")


@pytest.mark.parametrize("indexed", [False, True])
def test_bm25_against_sqlite(spark, sf_dir, tmp_path, indexed):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE d USING fts5(text)")
    con.executemany("INSERT INTO d(rowid, text) VALUES (?, ?)", rows)
    source = spark.createDataFrame(rows, "doc_id long, text string")
    if indexed:
        lexical.write_index(source, "doc_id", ["text"], str(tmp_path / "index"))
        source = lexical.open_index(spark, str(tmp_path / "index"), "bigint", ["text"])
    for q in QUERIES:
        want = {r[0]: round(r[1], 6) for r in con.execute("SELECT rowid, bm25(d) FROM d WHERE d MATCH ?", (q,))}
        got = {r.doc_id: round(r["rank"], 6) for r in lexical.bm25(source, lexical.parse_query(q), "doc_id", ["text"]).collect()}
        assert set(got) == set(want), q
        if "NEAR" not in q and " OR is" not in q:
            assert got == pytest.approx(want, abs=2e-6), q


def test_columns_against_sqlite(spark, tmp_path):
    rows = [(1, "alpha beta", "gamma delta"), (2, "gamma", "alpha x y beta"), (3, "delta alpha", None), (4, "", "beta alpha gamma"), (5, "beta", "alpha")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE d USING fts5(a, b)")
    con.executemany("INSERT INTO d(rowid, a, b) VALUES (?, ?, ?)", rows)
    docs = spark.createDataFrame(rows, "id long, a string, b string")
    lexical.write_index(docs, "id", ["a", "b"], str(tmp_path / "index"))
    index = lexical.open_index(spark, str(tmp_path / "index"), "bigint", ["a", "b"])
    for q in ("a : alpha", "{a b} : gamma", "b : (alpha OR delta)", '"alpha gamma"', "a : ^delta OR b : beta", "NEAR(alpha beta, 2)", "NEAR(alpha beta, 1)", "b : NEAR(alpha beta)", "a : alpha b : gamma", "{a} : beta + x"):
        want = {r[0] for r in con.execute("SELECT rowid FROM d WHERE d MATCH ?", (q,))}
        for source in (docs, index):
            assert {r.id for r in lexical.bm25(source, lexical.parse_query(q), "id", ["a", "b"]).collect()} == want, q
    plan = lexical.bm25(index, lexical.parse_query("alpha"), "id", ["a", "b"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(token,alpha)" in plan
    assert lexical.search(index, " ", "id", ["a", "b"]).count() == 0 and lexical.search(index, "nowhere", "id", ["a", "b"]).count() == 0
    lexical.write_index(docs.limit(0), "id", ["a", "b"], str(tmp_path / "none"))
    assert lexical.search(lexical.open_index(spark, str(tmp_path / "none"), "bigint", ["a", "b"]), "alpha", "id", ["a", "b"]).count() == 0


def test_query_grammar():
    P = lexical.Phrase
    a, b, c = P(("a",)), P(("b",)), P(("c",))
    assert lexical.parse_query("  ") is None
    assert lexical.parse_query("a b") == lexical.Both((a, b))
    assert lexical.parse_query("a OR b NOT c") == lexical.Either((a, lexical.Without(b, c)))
    assert lexical.parse_query("a NOT b c") == lexical.Without(a, lexical.Both((b, c)))
    assert lexical.parse_query("(a OR b) AND c") == lexical.Both((lexical.Either((a, b)), c))
    for text in ("C++", "foo AND", 'say "hi', "a-b", "NOT x", "(a", "NEAR(a, x)", "a : ", "{a : b"):
        assert isinstance(lexical.parse_query(text), P), text
    assert lexical.parse_query('"') is None
    assert lexical.parse_query('"a b" c*') == lexical.Both((P(("a", "b")), P(("c",), True)))
    assert lexical.parse_query("Café") == P(("cafe",))
    assert lexical.parse_query("NEAR(a b, 3)") == lexical.Near((a, b), 3) and lexical.parse_query("near") == P(("near",))


def test_blank_query(spark):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    assert lexical.search(df, " ", "id", ["t"]).count() == 0


def test_hash_embedder_is_what_it_says(spark):
    import hashlib

    own = indexing.HashEmbedder(16)
    v = own.embed_texts(["Ab ab c", "客户"])
    want = np.zeros(16)
    for token, n in (("ab", 2), ("c", 1)):
        want[int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little") % 16] += n
    want = np.log1p(want)
    assert np.allclose(v[0], want / np.linalg.norm(want))
    assert (v[1] == 1).sum() == 1
    assert own.embed_images([b"\x00\x01"]).shape == (1, 16)
    df = indexing.embedded(spark.createDataFrame([("Ab ab c",), (None,)], "t string"), lambda: indexing.HashEmbedder(16), "t")
    assert np.allclose(df.first()["embedding"], v[0])


def test_dense_ids(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 7 % 1000).repartition(5)
    got = tables.dense_ids(df, "n", 10, "k").orderBy("k").select("n").collect()
    assert [r.n for r in got] == list(range(10, 1010))
    assert tables.dense_ids(df.limit(0), "n", 1, "k").count() == 0


def test_dense_ids_over_many_ranges(spark, monkeypatch):
    """Wide and skewed rows, more partitions than ranges have, adaptive execution on."""
    monkeypatch.setattr(tables, "RANGE_ROWS", 3_000)
    wide = F.repeat(F.md5(F.col("id").cast("string")), 10)
    df = spark.range(0, 120_000, 1, 16).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.hash("id"))).alias("k"), F.col("id"), wide.alias("w"))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    out = tables.dense_ids(df, "n", 5, "k").select("k", "id", "n")
    told = out.agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n"), F.count_distinct("id")).first()
    assert tuple(told) == (120_000, 120_000, 5, 120_004, 120_000)
    spans = out.groupBy("k").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("c")).orderBy("k").collect()
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:])) and all(s.hi - s.lo + 1 == s.c for s in spans)
    with pytest.raises(ValueError):
        tables.dense_ids(df.withColumn("_tie", F.lit(1)), "n", 1, "k")


def test_dense_ids_with_nulls_and_several_columns(spark, monkeypatch):
    monkeypatch.setattr(tables, "RANGE_ROWS", 10)
    rows = [(None if i % 5 == 0 else i % 7, f"t{i}", {"a": i}) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b string, m map<string,int>").repartition(6)
    got = tables.dense_ids(df, "n", 1, "a", "b").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 201))
    assert [(r.a, r.b) for r in got] == sorted(((a, b) for a, b, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1, "m", 10), ("b", 2, None, 11)], "path string, size int, mime string, created int")
    new = spark.createDataFrame([("b", 3, None, 20), ("c", 4, "x", 20)], "path string, size int, mime string, created int")
    once = tables.upsert(old, new, "path", ["size", "mime"], ["created"])
    assert sorted(map(tuple, once.collect())) == [("a", 1, "m", 10), ("b", 3, None, 11), ("c", 4, "x", 20)]
    assert sorted(map(tuple, tables.upsert(once, new, "path", ["size", "mime"], ["created"]).collect())) == sorted(map(tuple, once.collect()))


def test_state_value(spark):
    df = spark.createDataFrame([("a", '{"x": 1}'), ("b", "not json")], "key string, value string")
    assert [tables.state_value(df, k, "d").first().value for k in ("a", "b", "c")] == ['{"x":1}', "not json", "d"]


def state_machine(samples, pause_after, resume_after):
    paused, high, since, out = False, None, 0.0, []
    for at, now in samples:
        if now != high:
            high, since = now, at
        if high and at - since >= pause_after:
            paused = True
        elif not high and at - since >= resume_after:
            paused = False
        out.append(paused)
    return out


def test_debounce(spark):
    rng, rows, want = random.Random(1), [], {}
    for key in range(40):
        at, samples = 0.0, []
        for _ in range(60):
            at += rng.choice([1.0, 2.0, 5.0])
            samples.append((at, rng.random() < 0.5 if rng.random() < 0.3 or not samples else samples[-1][1]))
        rows += [(key, t, h, i) for i, (t, h) in enumerate(samples)]
        want |= {(key, i): p for i, p in enumerate(state_machine(samples, 6, 9))}
    df = spark.createDataFrame(rows, "k int, at double, high boolean, event_id int")
    got = {(r.k, r.event_id): r.paused for r in load.debounced(df, "k", "at", "high", 6, 9).collect()}
    assert got == want


def test_throttle(spark):
    rng, rows, want = random.Random(2), [], set()
    for key in range(20):
        times = sorted(rng.randrange(0, 5_000) for _ in range(rng.randrange(1, 80)))
        rows += [(key, t, i) for i, t in enumerate(times)]
        last = None
        for i, t in enumerate(times):
            if last is None or t - last >= 300:
                want.add((key, t, i))
                last = t
    df = spark.createDataFrame([*rows, (None, 1, 1), (3, None, 99)], "k int, at_ms long, event_id long").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = [tuple(r) for r in load.throttled(df, "k", "at_ms").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == want
    assert load.throttled(df.limit(0), "k", "at_ms").count() == 0


def test_segments_are_stripped_of_all_white_space(spark):
    df = spark.createDataFrame([(1, 0.0, 1.5, "\t hi\u3000there \n"), (1, 2.0, 3.0, "\xa0\x1f"), (1, 3.0, 4.0, None)], "file_id long, start_s double, end_s double, text string")
    assert [tuple(r) for r in indexing.segment_chunks(df).collect()] == [(1, 0, 1500, "hi\u3000there")]
    from fathomix.functions.text import WHITE

    assert all(c.isspace() for c in WHITE) and len(WHITE) == sum(chr(c).isspace() for c in range(0x110000))


def zipped(**names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in names.items():
            z.writestr(name, body)
    return out.getvalue()


def test_archives(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("d/x.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    rows = [("/a.zip", zipped(**{"docs/readme.txt": "hello", "e.md": ""})), ("/b.tar.gz", tar.getvalue()), ("/c.zip", b"broken")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {(r.path, r.inner_path): r for r in archives.read_members(df, True).collect()}
    assert bytes(got["/a.zip", "docs/readme.txt"].content) == b"hello"
    assert got["/b.tar.gz", "d/x.txt"].mtime_ns is None and got["/b.tar.gz", "d/x.txt"].size_bytes == 2
    assert got["/c.zip", None].error
    listed = archives.read_members(df, False).where("error is null")
    assert {r.inner_paths for r in archives.listed_paths(listed, "path").collect()} == {"docs/readme.txt\ne.md", "d/x.txt"}


def test_zip_slip(spark):
    bad = spark.createDataFrame([("../evil.txt",)], "inner_path string")
    with pytest.raises(Exception, match="leaves its folder"):
        archives.guarded(bad).collect()
    assert archives.guarded(spark.createDataFrame([("a/b.txt",)], "inner_path string")).count() == 1


def test_knn(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vector_id long, embedding array<float>")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    want = np.argsort(-(unit @ unit[5]))[:4].tolist()
    assert [r.vector_id for r in knn.knn(df, data[5].tolist(), 4).collect()] == want
    queries = df.where("vector_id < 30").select(F.col("vector_id").alias("query_id"), "embedding")
    got = knn.knn_batch(df, queries, 3).orderBy("query_id", "rank").collect()
    assert [r.vector_id for r in got] == [x for q in range(30) for x in np.argsort(-(unit @ unit[q]))[:3].tolist()]
    assert knn.knn(df, data[5].tolist(), 0).count() == 0
    with pytest.raises(Exception, match="components"):
        knn.checked(df, 9).collect()


def test_knn_batch_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(knn, "DATA_BLOCK", 40)
    rng = np.random.default_rng(1)
    data = rng.normal(size=(230, 6))
    data[100:150] = data[0]  # ties go to the smaller id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vector_id long, embedding array<double>")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    queries = df.where("vector_id % 5 = 0").select(F.col("vector_id").alias("query_id"), "embedding")
    got = {}
    for r in knn.knn_batch(df, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vector_id)
    assert set(got) == set(range(0, 230, 5))
    for q, found in got.items():
        sims = unit @ unit[q]
        assert np.allclose(sims[found], np.sort(sims)[::-1][:4]) and found[0] == min(np.flatnonzero(np.isclose(sims, sims.max(), atol=1e-12)))
    assert knn.knn_batch(df.limit(0), queries, 4).count() == 0 == knn.knn_batch(df, queries.limit(0), 4).count()


def test_lsh_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("vector_id"), "embedding").cache()
    rows = {r.vector_id: list(map(float, r.embedding)) for r in vectors.where("vector_id % 400 = 3").collect()}
    found = wanted = 0
    for q in rows.values():
        exact = {r.vector_id for r in knn.knn(vectors, q, 10).collect()}
        found += len(exact & {r.vector_id for r in knn.knn_lsh(vectors, q, 10).collect()})
        wanted += len(exact)
    assert found >= 0.9 * wanted and wanted >= 50


def test_work_folders_are_named_and_released(spark):
    from fathomix import work

    before = work.named()
    df = work.written(spark.range(5), "x")
    (path,) = [p for p in work.named() if p not in before]
    assert df.count() == 5
    work.release([path])
    assert path not in work.named()
    with pytest.raises(Exception):
        df.count()
    work.release([path])
