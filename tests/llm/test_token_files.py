import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomix.llm import token_files as T
from fathomix.llm.common import range_bounds, range_bucket

PATH = P.path("word_bpe_49k.json")


def library_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 20, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype("<u4")
    raw = T.pack(ids, bits)
    assert len(raw) == -(-1003 * bits // 8)
    assert (T.unpack(raw, 1003, bits) == ids).all()
    assert (T.unpack(raw, 10, bits, 500) == ids[500:510]).all()
    assert len(T.unpack(T.pack(ids[:0], bits), 0, bits)) == 0


def test_encoder_is_the_library():
    rng = random.Random(11)
    alphabet = list("abXY  \n\t's'1!é́ßñ漢ΣİÅ_#<|>") + ["<|endoftext|>", " the", "'ll", "\x1c", " ", "ê", "é "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(800)] + ["x" * 5000, "", " "]
    encoder, library = T.ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for text, raw in zip(part, encoder.encode(pa.array(part)).to_pylist()):
            assert np.frombuffer(raw, encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(T, "KEPT_CHUNKS", 20)
    encoder, library = T.ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    for k in range(6):
        texts = [f"word{k}{i}, and İ. more" for i in range(5 * k)] + [None, "last one"]
        got = encoder.encode(pa.array(texts, pa.string()), end=2).to_pylist()
        assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert len(encoder._rows) < 100


def test_files(spark, monkeypatch):
    monkeypatch.setattr(T, "FILE_DOCS", 4)
    rows = [(7, "hello world"), (3, None), (3, ""), (5, "a b, c! " * 40_000), (None, "null id"), (9, "it's"), (2, "x"), (7, "hello world"), (11, "end"), (12, "more"), (13, "still more")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library_ids(t), 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in T.token_files(df, PATH).orderBy("start").collect()]
    assert got == want
    folder = T.new_path(spark, "tokens")
    manifest = T.write_token_files(df, PATH, 2, folder).orderBy("part").collect()
    assert len(manifest) > 1
    reader = T.FileReader(manifest[-1]["uri"])
    for i, (_, _, ids) in enumerate(list(reader.documents())):
        assert (reader.document(i) == ids).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_files(df, PATH).count() == 0


def test_large_ids_beside_null(spark):
    ids = [2**53 + 1, 2**53 + 3, None, -(2**63) + 1, 2**63 - 1]
    df = spark.createDataFrame([(i, "some text") for i in ids], "doc_id long, text string").coalesce(1)
    got = [r.doc_id for r in T.token_files(df, PATH).orderBy("start").collect()]
    assert got == [None, -(2**63) + 1, 2**53 + 1, 2**53 + 3, 2**63 - 1]


def test_one_id_of_many_rows_is_split(spark, monkeypatch):
    monkeypatch.setattr(T, "FILE_DOCS", 8)
    rows = [(5, f"text {i}") for i in range(100)] + [(None, f"none {i}") for i in range(50)] + [(i, "own") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = T.write_token_files(df, PATH, 2, T.new_path(spark, "tokens"))
    assert max(r.n_docs for r in manifest.collect()) < 40
    got = T.read_token_files(manifest).orderBy("start").collect()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert len(got) == 200 and keys == sorted(keys)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_range_buckets_keep_order(spark):
    df = spark.range(3000).select((F.col("id") % 7 * F.when(F.col("id") % 3 == 0, 0).otherwise(1)).alias("v"))
    bounds = range_bounds(df, "v", 100)
    buckets = df.select("v", range_bucket(F.col("v"), bounds, F.xxhash64(F.rand(3))).alias("b"))
    spans = sorted((r.v, r.lo, r.hi) for r in buckets.groupBy("v").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).collect())
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    assert spans[0][2] - spans[0][1] >= 8 and max(r["count"] for r in buckets.groupBy("b").count().collect()) < 400
