import fnmatch
import json
import random

import pytest
from pyspark.sql import functions as F

from fathomix.functions import paths, text, vectors


def test_chunks(spark):
    df = spark.createDataFrame([("a" * 120,)], "text string")
    got = [(r.chunk_no, r.start_offset, r.end_offset, len(r.chunk_text)) for r in text.with_chunks(df, "text", 50, 10).orderBy("chunk_no").collect()]
    assert got == [(0, 0, 50, 50), (1, 40, 90, 50), (2, 80, 120, 40)]


def test_chunks_against_a_loop(spark):
    df = spark.createDataFrame([(n, "é" * n) for n in range(0, 200, 3)], "n int, text string")
    got = {}
    for r in text.with_chunks(df, "text", 50, 10).collect():
        got.setdefault(r.n, []).append((r.start_offset, r.end_offset))
    for n in range(0, 200, 3):
        want, at = [], 0
        while n and (not want or want[-1][1] < n):
            want.append((at, min(at + 50, n)))
            at += 40
        assert sorted(got.get(n, [])) == want


@pytest.mark.parametrize("chars,overlap", [(0, 0), (10, -1), (10, 10)])
def test_bad_chunking(chars, overlap):
    with pytest.raises(ValueError):
        text.check_chunking(chars, overlap)


def test_sensitive_paths(spark):
    df = spark.createDataFrame([("/root/x/.ssh/id_rsa",), ("/root/x/a.txt",), ("/root/xy/a.txt",), ("/root/x",)], "path string")
    ok = paths.allowed(F.col("path"), ["/root/x"], ["**/.ssh/**", "**/*id_rsa*"])
    assert [r.path for r in df.where(ok).collect()] == ["/root/x/a.txt", "/root/x"]


def test_globs_against_fnmatch(spark):
    rng = random.Random(4)
    alphabet = "ab/.*?[]!-^\\&z"
    globs = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    names = ["".join(rng.choice("ab/.-z]^") for _ in range(rng.randrange(0, 7))) for _ in range(200)]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    rows = df.select("path", *(F.col("path").rlike(paths.glob_pattern(g)).alias(f"g{i}") for i, g in enumerate(globs))).collect()
    for r in rows:
        for i, g in enumerate(globs):
            assert r[f"g{i}"] == fnmatch.fnmatchcase(r.path, g), (r.path, g)


def test_types(spark):
    names = ["a.TXT", "b.tar.gz", "c.tgz", ".env", "d", "e.pdf", "f.gz", "x.tar.GZ", "m.JPeg", "v.mkv", "o.opus"]
    df = spark.createDataFrame([(f"/x.txt/{n}",) for n in names], "path string")
    got = [r[0] for r in df.select(paths.file_type(F.col("path"))).collect()]
    assert got == ["text", "archive", "archive", None, None, "pdf", None, "archive", "image", "video", "audio"]


def test_json(spark):
    cases = ['{"a": 1}', ' {"a": 1} ', 'x {"a": 1} y', "none", "", '{"a": {"b": 1}} }', None, "[1]"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(F.to_json(text.json_in(F.col("t")))).collect()]
    assert [None if g is None else json.loads(g) for g in got] == [{"a": 1}, {"a": 1}, {"a": 1}, None, None, None, None, [1]]


def test_since():
    assert paths.parse_since("2024-01-01") == 1704067200_000_000_000
    assert paths.parse_since(" ") is None and paths.parse_since(None) is None
    with pytest.raises(ValueError):
        paths.parse_since("yesterday")


def test_normalized(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [list(map(lambda x: round(x, 9), r[0])) for r in df.select(vectors.normalized(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
