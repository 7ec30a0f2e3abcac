import hashlib
import random
import re

from pyspark.sql import functions as F

from fathomix.llm import fingerprints as P

ANCHORS = {w for ws in P.ANCHORS.values() for w in ws.split()}


def spots(text):
    """Chains as tuples: after an anchor or the beginning, the next CHAIN content words."""
    words = [w for w in re.sub(r"[\W_]+", " ", (text or "").lower()).split() if w]
    out = set()
    for i in range(-1, len(words)):
        if i < 0 or words[i] in ANCHORS:
            chain = [w for w in words[i + 1 :] if w not in ANCHORS][: P.CHAIN]
            if chain:
                out.add(tuple(chain))
    return out


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(df, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(spots(t), spots(edited)), likeness(spots(t), spots(nxt)))
    prints = {}
    for r in P.fingerprints(df).collect():
        n, sha, near_edited, near_next = want.pop(r.doc_id)
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - near_edited) < 1e-9 and abs(r.near_next - near_next) < 1e-9
        prints.setdefault(dict(rows)[r.doc_id] or "", set()).add(r.fingerprint)
    assert not want
    assert all(len(p) == 1 for p in prints.values())


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 6)
    rng = random.Random(1)
    words = [*sorted(ANCHORS)[:40], *(f"wort{i}" for i in range(60)), "über", "naïve"]
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(40)]
    rows += [(1, None), (2, ""), (4, "the of and"), (5, "word " * 30_000), (7, rows[3][1]), (8, "é漢 The CAT, the-dog!"), (None, "null id has words")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, members string")
    check(df, rows)


def test_one_row_and_none(spark):
    rows = [(1, "the only text")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert P.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_pairs(spark):
    rng = random.Random(2)
    words = [*sorted(ANCHORS)[:30], *(f"w{i}" for i in range(50))]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(60)] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, t in rows:
        if spots(t):
            first.setdefault(frozenset(spots(t)), i)
    classes = sorted((i, s) for s, i in first.items())
    want = {(a, b) for a, s in classes for b, t in classes if a < b and likeness(s, t) >= 0.6}
    assert {(r.id_a, r.id_b) for r in P.near_pairs(df, 0.6).collect()} == want


def test_near_pairs_with_repeated_and_null_ids(spark, monkeypatch):
    from fathomix.llm import common

    rng = random.Random(4)
    base = [rng.choice([*sorted(ANCHORS)[:20], *(f"w{i}" for i in range(80))]) for _ in range(200)]
    changes = ([*base[:k], "changed", *base[k + 1 :]] for k in range(200))
    near = next(x for x in changes if 0.8 <= likeness(spots(" ".join(base)), spots(" ".join(x))) < 1)
    unlike = " ".join(f"u{i} the" for i in range(30))
    a, b = " ".join(base), " ".join(near)
    similarity = likeness(spots(a), spots(b))
    for heavy, salt in ((10**6, 1000), (1, 1)):
        monkeypatch.setattr(common, "heavy_from", lambda total, heavy=heavy: heavy)
        monkeypatch.setattr(P, "SALT_ROWS", salt)
        for rows, want in (
            ([(1, a), (2, b)], [(1, 2)]),
            ([(1, a), (2, b), (1, unlike)], [(1, 2)]),
            ([(None, a), (None, b), (None, unlike), (None, None)], [(None, None)]),
            ([(5, a), (5, b), (9, a)], [(5, 5)]),
        ):
            got = P.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
            assert [(r.id_a, r.id_b) for r in got] == want and abs(got[0].similarity - similarity) < 1e-9


def test_one_id_of_many_rows(spark, monkeypatch):
    """Rows of one id are ordered by a hash of their texts, over several ranges; each finds a next one."""
    monkeypatch.setattr(P, "RANGE_ROWS", 5)
    rows = [(7, f"text number {i} of the id") for i in range(60)] + [(None, f"no id {i % 3}") for i in range(30)] + [(i, f"own {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.with_next(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, rows))
    followed = sorted(r.next_text for r in got)
    assert followed == sorted(t for _, t in rows)  # a cycle: every text follows once


def test_no_python_in_the_plan(spark, sf_dir):
    df = P.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert df.select(F.min("near_next")).first()[0] >= 0
