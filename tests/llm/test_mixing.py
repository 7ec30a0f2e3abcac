import re

import pytest
from pyspark.sql import functions as F

from fathomix.llm import mixing as M

WEIGHTS = (5.0, 2.0, 1.0)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Capping and resharing, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        if not open_:
            return capped
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(df, rows):
    got = [r.asDict() for r in M.mix(df).collect()]
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=repr) == sorted(((i, s, size(t)) for i, t, s in rows), key=repr)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    taken = {}
    largest = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        full = int(want[r["source"]] // sizes[r["source"]]) if sizes[r["source"]] else 0
        assert r["copies"] in (min(full, 3), min(full + 1, 3))
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s] / 2 + 1e-6
    return got


def test_cases(spark):
    rows = [(i, "word " * (i % 17 + 1), f"s{i % 5}") for i in range(300)]
    rows += [(1000, None, "s0"), (1001, "", None), (1002, "a b c\x0bd\x1ce", None), (None, "x y", "tiny"), (7, "word word", "s1"), (7, "word word", "s1"), (1003, "", "void")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, target double")
    first = check(df, rows)
    again = [r.asDict() for r in M.mix(df.repartition(7)).collect()]
    key = lambda r: repr(sorted(r.items(), key=str))
    assert sorted(map(key, first)) == sorted(map(key, again))


def test_take_mix(spark):
    rows = [(i, "word " * (i % 7 + 1), f"s{i % 2}") for i in range(90)]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, source string, lang string")
    counts = {}
    taken = M.take_mix(df)
    assert taken.columns == df.columns
    for r in taken.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {r.doc_id: r.copies for r in M.mix(df).collect() if r.copies}


def test_take_mix_with_clashing_columns(spark):
    own = ["_size", "_key", "_source", "_cell", "_copies", "_p_target", "_p_rest", "row", "id", "s", "size", "key", "cell", "copies", "copy", "n", "edge", "before", "target", "part", "rank"]
    rows = [(i, "word " * (i % 5 + 1), f"s{i % 2}", *range(11, 11 + len(own))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in own))
    taken = M.take_mix(df)
    assert taken.columns == df.columns
    assert set(map(tuple, taken.collect())) <= set(rows) and taken.count() > 0


def test_cells_stay_small_whatever_the_text(spark):
    """Texts without blanks have other quality weights; no cell may hold many of a source's rows."""
    texts = ["".join(chr(0x4E00 + (i * 7 + k * k) % 900) for k in range(60)) for i in range(20_000)]
    df = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    drawn = M.draws(F.col("doc_id"), F.col("text"), F.col("source"), 42, M.text_quality)
    cells = M.with_cells(df.select(*(c.alias(k) for k, c in drawn.items()))).groupBy("cell").count()
    assert cells.agg(F.max("count")).first()[0] <= 20


def test_quality_tells_junk_from_prose(spark):
    """On labelled rows: how often a good text weighs more than a bad one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    size = F.coalesce(F.regexp_count("text", F.lit(M.WORD)), F.lit(0))
    rows = docs.select("quality", M.text_quality(F.col("text"), size).alias("w")).where("w is not null").collect()
    good, bad = [r.w for r in rows if r.quality == 1], [r.w for r in rows if r.quality == 0]
    assert bad and sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert all(0.01 <= r.w <= 1 for r in rows)


def test_sampling_follows_the_weights(spark):
    """Of documents of one size, those that weigh four times as much are drawn far more often, as the method has it."""
    rows = [(i, ("good word list here " if i % 2 else "poor poor poor poor ") * 2, src) for src in ("a", "b") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    quality = lambda text, size: F.when(text.startswith("good"), 1.0).otherwise(0.25)
    got = M.mix(df, quality=quality).where("source = 'b'").collect()
    base = min(r.copies for r in got)
    more = {0: 0, 1: 0}
    for r in got:
        more[r.doc_id % 2] += r.copies - base
    # b takes 2/7 of all, 4/7 of its own size, in no full epoch: without replacement, P(key < t) = 1 - exp(-w t).
    t = 1.6414  # where the two classes' mean of 1 - exp(-w t) is 4/7
    import math

    assert base == 0
    assert abs(more[1] / 3_000 * 2 - (1 - math.exp(-t))) < 0.04 and abs(more[0] / 3_000 * 2 - (1 - math.exp(-t / 4))) < 0.04


def test_many_sources_in_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_SOURCES", 7)
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 3)
    rows = [(i, "word " * (i * i % 13 + 1), f"h{i % 40}" if i % 3 else "hot") for i in range(400)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(df).count() == 0 and M.take_mix(df).count() == 0


def test_one_source_and_no_words(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in M.mix(df).collect()] == [(0, 0.0, 0)] * 2


def test_sample_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs, [(r.doc_id, r.text, r.source) for r in docs.collect()])
