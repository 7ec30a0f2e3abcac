import math
import random
import re
import zlib

from fathomix.llm import toxicity as X


def corpus(n=700, seed=0):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("ren", "sto", "lin", "vak", "tur")]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(["zorkelhaft", "zorkeling", "zorkelent"]))
        docs.append((i, " ".join(text) + ".", "en", "s"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_learned_stems_reach_unlabelled_rows(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs + [(9001, None, None, None), (9002, "", "en", "s"), (None, "null id", "en", "s"), (9003, "zorkelneu and zorkelhaft", "xx", "zz")], "doc_id long, text string, lang string, score string")
    rows = {r.doc_id: r for r in X.classify(d, spark.createDataFrame(labels + [(4, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")).collect()}
    assert len(rows) == 704
    for i, *_ in docs:
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert rows[i].predicted == int(i % 5 == 0) == int(rows[i].score >= 0.5)
    assert rows[9001].score == rows[9002].score < 0.5 and rows[9003].score > 0.4 and rows[None].held_out
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    make = lambda rows: X.learn(d, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    assert make(labels) == make(turned)


def test_grammar():
    lexicon = X.Lexicon({})
    one = lambda t: sum(s for s, _, _ in lexicon.clauses(t))
    assert one("what an idiot") == 0.5 * X.PRIOR_WEIGHT
    assert one("you are an idiot") == X.PRIOR_WEIGHT > one("what an idiot") > one("not an idiot") > 0
    assert one("they said idiot") < one("you idiot") and one("he said it. what an idiot") == one("what an idiot")
    assert 0 < one("kill the process") < one("idiot")
    assert one("a fine day") == 0 == one("")
    table, start = X.grammar()
    assert len(table) > 4 and 0 <= start < len(table)


def test_composition_adds_bits():
    both = X.compose(X.compose(X.hit_machine(), X.counter_machine(X.TARGET, X.TARGETED)), X.latch_machine(X.REPORT, X.REPORTED))
    state, marks = both.start, []
    for s in (X.TARGET, X.REPORT, X.INSULT, X.BREAK, X.INSULT):
        state, told, _ = both.step[state, s]
        marks.append(told)
    assert marks == [(), (), ((0, X.TARGETED | X.REPORTED),), (), ((0, 0),)]


def brute_score(model, text):
    """The score by looking around each word, without any machine."""
    fixed = {w: k for k, words in (("t", X.TARGETS), ("n", X.NEGATIONS), ("r", X.REPORTS), ("h", X.THREATS), ("i", X.INSULTS)) for w in words}
    z = model.intercept + model.length * X.word_scale(len(re.findall(r"\w+", text.lower())))
    for clause in re.split(r"[.!?;\n]", text.lower()):
        words = re.findall(r"\w+", clause)
        told = []
        for w in words:
            stems = [model.stems[s] for s in model.stems if w.startswith(s)]
            told.append(("i", sum(stems)) if stems else (fixed.get(w, "o"), X.PRIOR_WEIGHT))
        kind = [k for k, _ in told]
        near = lambda i, k: k in kind[max(0, i - X.REACH) : i]
        for i, (k, weight) in enumerate(told):
            said = X.REPORTED if "r" in kind[:i] else 0
            if k in "ih":
                bits = said | (X.TARGETED if near(i, "t") else 0) | (X.NEGATED if near(i, "n") else 0)
                z += weight * model.factors[X.pattern(("ih".index(k), bits))]
            if k == "t":
                for j in range(max(0, i - X.REACH), i):
                    if kind[j] == "h" and not near(j, "t") and "t" not in kind[j:i]:
                        z += weight * model.factors[X.pattern((2, said | (X.NEGATED if near(j, "n") else 0)))]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_are_those_of_brute_force():
    rng = random.Random(7)
    factors = tuple(rng.random() for _ in X.prior_factors())
    model = X.Model({"zor": 1.5, "zorkel": 0.7, "idio": -0.2}, 0.3, -2.0, factors)
    pool = [*X.TARGETS[:4], *X.NEGATIONS[:3], *X.REPORTS[:3], *X.THREATS[:4], *X.INSULTS[:4], "zorkelhaft", "zorn", "plain", "words", "here", "and", "there", ".", "!", "\n", "YOU"]
    for _ in range(3000):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 30)))
        assert abs(model.score(text) - brute_score(model, text)) < 1e-9, text


def test_clauses_decide_not_words():
    """Sentences with the same insults and threats: with all factors 1 a bag of words cannot tell them apart."""
    toxic = "you are an idiot|you stupid moron|i will kill you|they are scum|du dummkopf|tu connard|you will burn|he is trash|your worthless clown|we will murder them".split("|")
    clean = "the word idiot is old|it was said that idiot and moron are rude|kill the process|they are not scum|not a dummkopf|he wrote connard once|burn the disc|put the trash out|a clown came|murder is a crime".split("|")
    grammar, bag = X.Model({}, 0.0, X.PRIOR_INTERCEPT), X.Model({}, 0.0, X.PRIOR_INTERCEPT, (1.0,) * len(X.prior_factors()))
    wrong = lambda m: sum(m.score(t) < 0.5 for t in toxic) + sum(m.score(t) >= 0.5 for t in clean)
    assert wrong(grammar) <= 1 and wrong(bag) >= 8


def patterned(n, seed):
    """Documents in which words tell nothing, but whether they stand at a target, negated or reported does."""
    rng = random.Random(seed)
    filler = "bread river table window garden paper stone music summer letter".split()
    docs, labels = [], []
    for i in range(n):
        toxic, clauses = i % 2, []
        for _ in range(rng.randrange(2, 5)):
            word = rng.choice(["zorkel", "plimpf", "graunk"])
            clauses.append(f"you are {word}" if toxic else rng.choice([f"nobody was {word} there", f"laut says {word} again", f"{' '.join(rng.sample(filler, 5))} {word}"]))
        clauses += [" ".join(rng.sample(filler, 4)) for _ in range(3)]
        rng.shuffle(clauses)
        docs.append((i, ". ".join(clauses) + f" x{i}"))
        labels.append((i, 1, toxic))
    return docs, labels


def test_factors_are_learned_and_their_ablation_is_worse():
    docs, labels = patterned(600, 1)
    stems = ["zorkel", "plimpf", "graunk"]
    raw = X.Model(dict.fromkeys(stems, 1.0), 0.0, 0.0)
    rows = []
    for (_, text), (_, _, y) in zip(docs, labels):
        words, fixed, counts = raw.lexicon.features(text)
        told = sorted((stems.index(s), p, c) for (s, p), c in counts.items())
        rows.append({"toxic": y, "words": words, "fixed_patterns": list(fixed), "fixed": list(fixed.values()), "stems": [t[0] for t in told], "patterns": [t[1] for t in told], "counts": [t[2] for t in told]})
    full, bag = X.fitted(rows[:400], stems), X.fitted(rows[:400], stems, (1.0,) * len(X.prior_factors()))
    errors = lambda m: sum((m.score(t) >= 0.5) != bool(y) for (_, t), (_, _, y) in zip(docs[400:], labels[400:]))
    assert errors(full) <= 4 and errors(bag) >= 40
    assert full.factors != X.prior_factors() and full.factors[X.pattern((0, 0))] < full.factors[X.pattern((0, X.TARGETED))]


def test_no_labels_and_no_rows(spark):
    d = spark.createDataFrame([(1, "you idiot moron, you scum"), (2, "fine")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.predicted for r in X.classify(d, none).collect()} == {1: 1, 2: 0}
    assert X.classify(d.limit(0), none).count() == 0
    assert [r.doc_id for r in X.keep_clean(d, none).collect()] == [2]


def test_held_out_accuracy(spark):
    """Recall and precision of held-out toxic rows, which answering 0 always, or 1 always, cannot reach."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = X.classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    caught, alarms = sum(r.predicted for r in toxic), sum(r.predicted for r in clean)
    assert len(toxic) > 50 and caught >= 0.9 * len(toxic) and alarms <= 0.01 * len(clean)


def test_very_long_text(spark):
    d = spark.createDataFrame([(1, "plain words go on and on. " * 60_000), (2, "plain " * 200_000 + "you idiot moron scum")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r.score for r in X.classify(d, none).collect()}
    assert rows[1] < 0.1 < rows[2]


def test_short_toxic_text_is_predicted(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([x[:2] for x in docs] + [(9001, ""), (9003, "zorkelneu and zorkelhaft")], "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in X.classify(d, labels).where("doc_id > 9000").collect()}
    assert rows[9003].predicted == 1 and rows[9003].score >= 0.5 and rows[9001].predicted == 0
    assert [r.doc_id for r in X.keep_clean(d, labels).where("doc_id > 9000").collect()] == [9001]


def test_a_target_on_either_side_completes_a_threat():
    import pytest

    lexicon = X.Lexicon({})
    one = lambda t: sum(s for s, _, _ in lexicon.clauses(t))
    whole = pytest.approx(X.PRIOR_WEIGHT)
    assert one("i will kill you") == whole == one("you will kill") and one("i will kill and burn you") == pytest.approx(2 * X.PRIOR_WEIGHT)
    assert one("kill the process") == pytest.approx(0.2 * X.PRIOR_WEIGHT) == one("kill the process. you") == one("kill one two three four you")
    assert one("kill one two three you") == whole == one("kill you you")
    assert one("i will not kill you") == pytest.approx(0.3 * X.PRIOR_WEIGHT) == one("not one two three kill one two you")
    assert one("he said it. i will kill you") == whole and one("it said kill you") == pytest.approx(0.4 * X.PRIOR_WEIGHT)


def test_threats_alone_are_predicted(spark):
    d = spark.createDataFrame([(1, "I will kill you. I will burn you."), (2, "kill the process. burn the disc.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.predicted for r in X.classify(d, none).collect()} == {1: 1, 2: 0}
