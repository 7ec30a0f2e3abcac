import math
import random
import re
import struct
import unicodedata

import pytest
import xxhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    from fathomix.llm import bpe, mixing, ngram_join, secrets, toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    clean = stages["toxicity"](spark, docs, sf_dir).cache()
    bad = {r.doc_id for r in toxicity.classify(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad
    single = stages["near_copies"](spark, clean, sf_dir).cache()
    assert {r.doc_id for r in single.collect()} == {r.class_id for r in ngram_join.near_duplicates(clean).collect()}
    masked = stages["secrets"](spark, single, sf_dir).cache()
    assert masked.count() == single.count()
    assert all(not secrets.base_spans(r.text) or "[SECRET]" in r.text for r in masked.collect())
    mixed = stages["mix"](spark, masked, sf_dir).cache()
    assert mixed.count() == sum(r.copies for r in mixing.mix(masked).collect())
    for df in (clean, single, masked, mixed):
        assert df.columns == docs.columns
    texts = {r.doc_id: r.text for r in mixed.collect()}
    own = bpe.RankBPE(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    coded = stages["encode"](spark, mixed, sf_dir).collect()
    assert len(coded) == mixed.count()
    assert all(own.decode(r.ids) == texts[r.doc_id] and len(r.ids) == r.n_tokens for r in coded)


def test_run(spark, sf_dir):
    from fathomix import work

    before = work.named()
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 100
    left = [p for p in work.named() if p not in before]
    assert len(left) == 1 and "pipeline-encode" in left[0]


def spark_hash(*values):
    """xxhash64 over columns, as SQL has it: nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, letters = len(words), sum(unicodedata.category(c)[0] == "L" for c in text)
    distinct = min(1.0, len(set(words)) / max(1.0, min(float(n), 4 * math.sqrt(n))))
    share = letters / max(len(text), 1)
    return max(0.01, distinct * min(1.0, max(0.01, (share - 0.5) / 0.3)) * (1 - sum(unicodedata.category(c) == "Lu" for c in text) / max(letters, 1)))


def brute_mix(rows):
    """How often each row is taken: targets by rounds of capping, keys sorted source by source."""
    import test_mixing

    size = lambda t: test_mixing.size(t)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    wanted, taken = test_mixing.targets(sizes), {}
    for source, total in sizes.items():
        epochs = min(3, int(wanted[source] // total)) if total else 0
        rest = 0.0 if epochs == 3 else wanted[source] - epochs * total

        def key(row):
            uniform = (spark_hash((42,), row[0], spark_hash(row[1])) % 2**52 + 0.5) / 2**52
            return -math.log(uniform) / max(1e-6, 1.0 if row[1] is None else brute_quality(row[1])), row[0] is not None, row[0] or 0, size(row[1])

        ahead = 0
        for row in sorted((r for r in rows if r[2] == source), key=key):
            more = epochs < 3 and rest > 0 and ahead + size(row[1]) / 2 <= rest
            ahead += size(row[1])
            taken[row] = taken.get(row, 0) + epochs + more
    return taken


def brute_masked(text, model):
    """Every token of the text decoded as one chain, without the tagger's shortcuts."""
    from fathomix.llm import secrets as S

    if not text:
        return text
    spans = [(s, e, v) for s, _, e, v in S.base_spans(text)]
    base = list(spans)
    for run in S.chains(text):
        words = [S.split_lead(m) for m in S.TOKEN.findall(text)]
        tags = model.viterbi(S.sequence_features(words, S.file_features(text)))
        more = []
        for (s, e), tag in zip(run, tags):
            if tag == S.I and more:
                more[-1] = (more[-1][0], e, more[-1][2])
            elif tag != S.O:
                more.append((s, e, s))
        spans += [m for m in more if not any(s < m[1] and e > m[0] for s, e, _ in base)]
    out, at = "", 0
    for _, end, secret in sorted(spans):
        if end > at:
            out += text[at : max(at, secret)] + "[SECRET]"
            at = end
    return out + text[at:]


def fixture():
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfglmnp" for b in "aeiou" for c in ("ren", "sto", "lin", "vak")]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randrange(8, 90))]
        toxic = i % 4 == 0
        for _ in range(4 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["zorkelhaft", "zorkeling", "zorkelent"]))
        if i % 7 == 3:
            text.insert(rng.randrange(len(text)), f"token = \"{rng.randrange(16**40):040x}\"")
        rows.append((i, " ".join(text) + ".", f"s{i % 4}" if i % 9 else None))
        labels.append((i, 1, int(toxic)))
        if i % 11 == 5:
            rows.append((1000 + i, rows[-1][1], "s1"))
            near = rows[-1][1].split(" ")
            near[-2] = "changed"
            rows.append((2000 + i, " ".join(near), "s0"))
    rows += [(5000, None, "s0"), (5001, "", None), (None, "no id of any kind has this text here", "s2"), (None, None, None), (3, rows[3][1], "s3"), (5002, "my password is CorrectHorseBatteryStaple today", "s1"), (5003, "word " * 30_000, "long")]
    return rows, labels


def test_run_is_that_of_brute_force(spark, tmp_path):
    import test_ngram_join
    import test_toxicity
    from tokenizers import Tokenizer

    from fathomix.llm import secrets, toxicity

    rows, labels = fixture()
    own = ["row", "_id", "_size", "kept", "score", "spans", "copies"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in own)
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), *range(len(own))) for i, t, s in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, marks = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    told = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()), key=repr)

    model = toxicity.learn(docs, marks)
    want = [r for r in rows if test_toxicity.brute_score(model, r[1] or "") < 0.5]
    assert 150 < len(want) < len(rows) - 40
    step = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    assert told(step) == sorted(want, key=repr) and step.columns == docs.columns

    classes, seen, single = test_ngram_join.brute([(i, t) for i, t, _ in want]), set(), []
    heads = {i: c for i, c, _ in classes if i is not None}
    for i, t, s in want:
        if i is None or (heads[i] == i and (i, t) not in seen):
            single.append((i, t, s))
        seen.add((i, t))
    assert len(single) < len(want) - 10
    step = stages["near_copies"](spark, step, str(tmp_path)).cache()
    assert [r[:2] for r in told(step)] == sorted((r[:2] for r in single), key=repr) and step.columns == docs.columns
    single = told(step)  # of rows equal in id and text either may stay

    crf = secrets.fit(step)
    masked = sorted(((i, brute_masked(t, crf), s) for i, t, s in single), key=repr)
    step = stages["secrets"](spark, step, str(tmp_path)).cache()
    assert told(step) == masked and sum("[SECRET]" in (t or "") for _, t, _ in masked) > 10 and step.columns == docs.columns

    copies = brute_mix(masked)
    mixed = sorted((r for r, n in copies.items() for _ in range(n)), key=repr)
    step = stages["mix"](spark, step, str(tmp_path)).cache()
    assert told(step) == mixed and step.columns == docs.columns
    assert {tuple(r[c] for c in own) for r in step.collect()} == {tuple(range(len(own)))}

    library = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t, _ in set(mixed)}
    coded = sorted(((i, len(ids[t]), ids[t]) for i, t, _ in mixed), key=repr)
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(((i, n, list(x)) for i, n, x in got), key=repr) == coded


def test_run_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
