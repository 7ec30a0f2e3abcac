import random
import re

from pyspark.sql import functions as F

from fathomix.llm import components as C, ngram_join as J


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def sets(text):
    w = words(text)
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) - 1e-9] for i in range(n)]
    root = list(range(n))
    for i in range(n):
        stack, seen = [i], {i}
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        root[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted(((rows[i][0], root[i], len(links[i])) for i in range(n)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in J.near_duplicates(df).collect()), key=repr)


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(25):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120, 300]))]
        for _ in range(rng.choice([1, 1, 3, 8])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "..."), (None, rows[0][1]), (903, rows[1][1].upper()), (903, rows[1][1].upper()), (2, "another text under an id in use already"), (904, "x"), (905, "x")]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int")
    assert got(df) == brute(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    text = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(60):
        copy = list(text)
        for _ in range(rng.choice([0, 1, 3, 5])):
            copy[rng.randrange(200)] = f"v{rng.randrange(99)}"
        rows.append((i, " ".join(copy)))
    for name, value in (("BUCKET_BLOCK", 7), ("GROUP_BLOCK", 9)):
        monkeypatch.setattr(J, name, value)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_keep_one(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "other words than those of the first text"), (3, None), (4, ""), (None, "q")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, rows[0][1]), (1, rows[3][1]), (3, None), (4, ""), (None, "q")], key=repr)


def test_keep_one_with_clashing_columns(spark):
    """Columns named like those the operator makes for itself keep their values."""
    names = ["doc_id", "text", "_id", "_t", "gone_id", "gone_t", "gone_i", "i", "t", "row", "kept", "words", "class_id", "copies", "h1"]
    text = "one two three four five six seven"
    rows = [(1, text, *range(11, 24)), (2, text, *range(31, 44)), (3, "quite another text of some words here", *range(51, 64))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names[2:]))
    kept = J.keep_one(df)
    assert kept.columns == names
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_null_ids_join_classes(spark):
    a, b = "one two three four five six seven eight", "some words that are found without any id at all"
    rows = [(None, a), (7, a), (9, a + " nine"), (None, b), (None, b), (None, b.upper()), (None, None), (None, None), (None, "..."), (4, "..."), (4, "...")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    kept = sorted(((r.doc_id, r.text) for r in J.keep_one(df).collect()), key=repr)
    assert kept in [sorted([(7, a), *nine, (None, x), (None, None), (None, None), (None, "..."), (4, "...")], key=repr) for x in (b, b.upper()) for nine in ([], [(9, a + " nine")])]


def test_heavy_keys_give_the_same(spark, monkeypatch):
    """One group of copies and one of near copies hold most rows, and count as heavy keys."""
    from fathomix.llm import common

    monkeypatch.setattr(common, "heavy_from", lambda total: 5)
    monkeypatch.setattr(J, "heavy_from", lambda total: 5)
    rng = random.Random(8)
    base = [f"w{rng.randrange(300)}" for _ in range(80)]
    rows = [(i, " ".join(base)) for i in range(30)]
    for i in range(30, 70):
        copy = list(base)
        copy[rng.randrange(80)] = f"v{i}"
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join(f"x{rng.randrange(300)}" for _ in range(40))) for i in range(70, 90)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def python_nodes(node):
    """Of each stage, how many of its nodes run Python one over the other, at most; the first is that of node."""
    below = [python_nodes(node.children().apply(i)) for i in range(node.children().size())]
    name, rest = node.nodeName(), [n for stages in below for n in stages[1:]]
    most = max((stages[0] for stages in below), default=0)
    if "Exchange" in name:
        return [0, most, *rest]
    return [most + bool(re.search("Pandas|Arrow|Python", name)), *rest]


def test_one_worker_a_task(spark, monkeypatch):
    """Each Python node of a stage holds a worker of its own in each task, and workers and their caches stay."""
    found = {}

    def seen(df, label, write=J.materialize):
        found.setdefault(label, []).append(max(python_nodes(df._jdf.queryExecution().executedPlan())))
        return write(df, label)

    monkeypatch.setattr(J, "materialize", seen)
    monkeypatch.setattr(C, "materialize", seen)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        J.classified(spark.createDataFrame(corpus(), "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {"signatures", "edges", "verified"} <= set(found)
    assert max(n for counts in found.values() for n in counts) == 1, found


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert got(df) == []
    assert J.keep_one(df).count() == 0


def test_least_matches_rise():
    least = J.least_matches()
    assert list(least) == sorted(least) and 0 < least[-1] < 0.8 * J.HASHES


def test_sample_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == brute(rows)
    assert docs.select(F.count("*")).first()[0] == 200
