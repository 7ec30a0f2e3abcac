"""Operator 7: toxicity by a weighted finite-state pattern grammar.

Words become symbols through a lexicon transducer (insult, threat, target,
negation, reported speech, other, end of clause), and a grammar transducer reads
the symbols of each clause. The grammar is the composition of four small
transducers: one marks insults, threats and the targets that complete a threat; three
tell which marks follow a target ("you"), follow a negation, or stand in reported
speech. So each mark has a pattern, and a document scores by its matched clauses: the
weight of each marked word times the factor of its pattern, a term for length and an
intercept sum up, and a logistic function turns the sum into a score from 0 to 1.

Fixed word lists hold the closed classes (targets, negations, verbs of saying,
threats) and some common insults. Insult stems and their weights are learned from
labelled rows outside the held-out fold, at most SAMPLE documents of which each
group of near-equal ones counts once: stems are word prefixes that depend on the
label by a likelihood-ratio test, of which the MOST_STEMS that tell most are kept, and
weights come from a ridge logistic regression on the grammar's output. The factors of
patterns are learned next, given the weights, and held to their priors: an insult alone
counts half of one at a target, one that is negated or reported less. Label, language,
source and id never enter a score.

Defined results: a null or empty text scores as a text without hits; a null id is
scored, counts as held out, and is never learned from; repeated rows get equal
scores; a document labelled twice is learned from once, as toxic if any label says
so; without labels of both kinds the fixed words alone count; an empty table gives no
rows. Columns other than doc_id and text are not carried by scoring.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from fathomix.llm.chunk_cache import GenerationCache
from fathomix.llm.common import materialize

# Closed word classes in English, French, German and Spanish.
TARGETS = "you your yours yourself u tu te toi vous du dich dir ihr euch sie usted ustedes vosotros ti he she they him her them".split()
NEGATIONS = "not no never none nobody without isn aren wasn don doesn didn won pas jamais aucun sans nicht nie kein keine ohne nunca jamás ningún sin".split()
REPORTS = "said says say told tells quoted quote quotes wrote claimed claims called according dit disait selon sagte sagt laut dijo dice según".split()
THREATS = "kill murder shoot stab strangle beat burn destroy hang slaughter tuer töten umbringen matar".split()
INSULTS = "idiot moron scum clown loser worthless pathetic disgusting trash stupid imbecile crétin salaud connard dummkopf arschloch gilipollas imbécil".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)
SYMBOLS, HITS = 7, (INSULT, THREAT)
#: Words over which a target or negation reaches.
REACH = 4
#: Labelled documents that stems and weights are learned from, and stems kept, at most.
SAMPLE, MOST_STEMS = 20_000, 300
#: Lengths of learned prefixes; least toxic documents with a stem, test statistic, and ratio of its rates.
PREFIXES, LEAST_SUPPORT, LEAST_G2, LEAST_RATIO = (3, 4, 5, 6, 7), 5, 20.0, 3.0
FOLDS = 5
#: The weight of a fixed word, and the intercept before anything is learned.
PRIOR_WEIGHT, PRIOR_INTERCEPT = 5.0, -4.0
#: How firmly learned factors of patterns are held to their priors: this times the sum of squares of what they multiply.
FACTOR_RIDGE = 0.05

WORDS = re.compile(r"\w+")
CLAUSES = re.compile(r"[^.!?;\n]+")


#: Kinds of marks: an insult, a threat, and a target that completes a threat before it.
KINDS = ("insult", "threat", "completed")
#: What a mark's clause may add to its pattern.
TARGETED, NEGATED, REPORTED = 1, 2, 4
Mark = tuple[int, int]  # kind, bits


def pattern(mark: Mark) -> int:
    return mark[0] * 8 + mark[1]


def prior_factors() -> tuple[float, ...]:
    """What each pattern counts before anything is learned: an insult alone half of one at a target, a threat alone little."""
    base = {0: (0.5, 1.0), 1: (0.2, 1.0), 2: (0.8, 0.8)}
    return tuple(base[k][bits & TARGETED] * (0.3 if bits & NEGATED else 1.0) * (0.4 if bits & REPORTED else 1.0) for k in range(len(KINDS)) for bits in range(8))


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: state and symbol to (state, marks); bits are added to all marks that come in."""

    step: dict[tuple[object, int], tuple[object, tuple[Mark, ...], int]]
    start: object


def counter_machine(trigger: int, bit: int) -> Transducer:
    """Sets a bit of hits within REACH words after trigger; a clause's end resets it."""
    step = {}
    for left in range(REACH + 1):
        for symbol in range(SYMBOLS):
            after = REACH if symbol == trigger else 0 if symbol == BREAK else max(0, left - 1)
            step[left, symbol] = (after, (), bit if symbol in HITS and left else 0)
    return Transducer(step, 0)


def latch_machine(trigger: int, bit: int) -> Transducer:
    """Sets a bit of all marks after trigger in the same clause."""
    step = {}
    for on in (0, 1):
        for symbol in range(SYMBOLS):
            after = 1 if symbol == trigger else 0 if symbol == BREAK else on
            step[on, symbol] = (after, (), bit if on else 0)
    return Transducer(step, 0)


def hit_machine() -> Transducer:
    """Marks insults and threats, and a target that follows a threat within REACH words and completes it.

    A state holds the words that the last target and the last negation still reach,
    and the waiting threats, by age: 0 for none, 1 for one, 2 for a negated one.
    """
    start = (0, 0, (0,) * REACH)
    step, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        target, negation, waiting = state
        for symbol in range(SYMBOLS):
            marks: tuple[Mark, ...] = ()
            new, after_waiting = 0, (0,) * REACH
            if symbol == INSULT:
                marks = ((0, 0),)
            elif symbol == THREAT:
                marks, new = ((1, 0),), 0 if target else 2 if negation else 1
            elif symbol == TARGET:
                marks = tuple((2, NEGATED if w == 2 else 0) for w in waiting if w)
            if symbol != TARGET:
                after_waiting = (new, *waiting[:-1])
            after = (REACH if symbol == TARGET else max(0, target - 1), REACH if symbol == NEGATION else max(0, negation - 1), after_waiting)
            after = start if symbol == BREAK else after
            step[state, symbol] = (after, marks, 0)
            if after not in seen:
                seen.add(after)
                todo.append(after)
    return Transducer(step, start)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same symbols; b's bits are added to a's marks. Only reachable states are built."""
    start = (a.start, b.start)
    step, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in range(SYMBOLS):
            (p, marks, have), (q, _, bits) = a.step[state[0], symbol], b.step[state[1], symbol]
            step[state, symbol] = ((p, q), tuple((kind, old | bits) for kind, old in marks), have | bits)
            if (p, q) not in seen:
                seen.add((p, q))
                todo.append((p, q))
    return Transducer(step, start)


@lru_cache(maxsize=1)
def grammar() -> tuple[list[list[tuple[int, tuple[int, ...]]]], int]:
    """The composed grammar as a table of (next state, patterns), with numbered states."""
    machine = hit_machine()
    for part in (counter_machine(TARGET, TARGETED), counter_machine(NEGATION, NEGATED), latch_machine(REPORT, REPORTED)):
        machine = compose(machine, part)
    number = {s: i for i, s in enumerate(dict.fromkeys(s for s, _ in machine.step))}
    table: list[list[tuple[int, tuple[int, ...]]]] = [[(0, ())] * SYMBOLS for _ in number]
    for (state, symbol), (after, marks, _) in machine.step.items():
        table[number[state]][symbol] = (number[after], tuple(map(pattern, marks)))
    return table, number[machine.start]


@dataclass(frozen=True)
class Model:
    """stems: prefix to weight; factors: of each pattern; length: of the logarithm of the number of words; intercept."""

    stems: dict[str, float]
    length: float
    intercept: float
    factors: tuple[float, ...] = prior_factors()

    @cached_property
    def lexicon(self) -> Lexicon:
        return lexicon_of(tuple(sorted(self.stems.items())), self.factors)

    def score(self, text: str) -> float:
        n, clauses = self.lexicon.read(text)
        z = self.intercept + self.length * word_scale(n) + math.fsum(s for s, _, _ in clauses)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def word_scale(n: int) -> float:
    """The logarithm of a length, held to a range so that the term does not run away for the shortest and longest texts."""
    return max(-2.0, min(3.0, math.log1p(n) - 6))


class Lexicon:
    """Maps words to symbols and weights: by their stems or else, as whole words, by the fixed lists."""

    def __init__(self, stems: dict[str, float], factors: tuple[float, ...] = prior_factors()) -> None:
        self.factors = factors
        self.fixed: dict[str, tuple[int, float]] = {}
        for words, symbol in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), (INSULTS, INSULT)):
            self.fixed |= {w: (symbol, PRIOR_WEIGHT) for w in words}
        self.stems = stems
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self._symbols = GenerationCache(self.symbol, 50_000)

    def symbol(self, word: str) -> tuple[int, float, tuple[str, ...]]:
        """Symbol, weight and stems of a word: all its stems add up, so that a rare ending still counts."""
        found = tuple(word[:n] for n in self.lengths if len(word) >= n and word[:n] in self.stems)
        if found:
            return INSULT, math.fsum(self.stems[s] for s in found), found
        return *self.fixed.get(word, (OTHER, 0.0)), ()

    def hits(self, lower: str, words: list[str]) -> Iterator[tuple[int, float, tuple[int, ...], tuple[str, ...], int, int]]:
        """(clause, weight, patterns, stems, start, end) of each word that the grammar marks.

        The grammar begins anew with each clause, so clauses without a word that can
        hit are passed over.
        """
        symbols = self._symbols
        able = {w for w in set(words) if symbols[w][0] in HITS}
        if not able:
            return
        table, start = grammar()
        for clause, m in enumerate(CLAUSES.finditer(lower)):
            if able.isdisjoint(WORDS.findall(m.group())):
                continue
            state = start
            for t in WORDS.finditer(lower, m.start(), m.end()):
                symbol, weight, stems = symbols[t.group()]
                state, patterns = table[state][symbol]
                if patterns:
                    yield clause, weight, patterns, stems, t.start(), t.end()

    def read(self, text: str) -> tuple[int, list[tuple[float, int, int]]]:
        """The number of words, and (score, start, end) of each clause with a hit."""
        lower = text.lower()
        words = WORDS.findall(lower)
        out: dict[int, tuple[float, int, int]] = {}
        for clause, weight, patterns, _, start, end in self.hits(lower, words):
            score, begun, _ = out.get(clause, (0.0, start, end))
            out[clause] = (score + weight * math.fsum(self.factors[p] for p in patterns), begun, end)
        return len(words), list(out.values())

    def clauses(self, text: str) -> list[tuple[float, int, int]]:
        return self.read(text)[1]

    def features(self, text: str) -> tuple[int, dict[int, float], dict[tuple[str, int], int]]:
        """The number of words, the weight of fixed words in each pattern, and how often each stem stands in each."""
        lower = text.lower()
        words = WORDS.findall(lower)
        fixed: dict[int, float] = {}
        out: dict[tuple[str, int], int] = {}
        for _, weight, patterns, stems, _, _ in self.hits(lower, words):
            for p in patterns:
                for stem in stems:
                    out[stem, p] = out.get((stem, p), 0) + 1
                if not stems:
                    fixed[p] = fixed.get(p, 0.0) + weight
        return len(words), fixed, out


@lru_cache(maxsize=1)
def lexicon_of(stems: tuple[tuple[str, float], ...], factors: tuple[float, ...]) -> Lexicon:
    """One lexicon a worker and model, so that its cache outlives a task and no second one stands beside it."""
    return Lexicon(dict(stems), factors)


def fold(doc_id):
    """crc32 of the id as text, modulo FOLDS; null counts as 0, the held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def near_key(text: str) -> int:
    """The smallest hash of five-word shingles: near-equal texts mostly share it."""
    words = WORDS.findall(text.lower())
    return min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) >> 1 for i in range(max(1, len(words) - 4))), default=0)


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of at most SAMPLE labelled documents outside the held-out fold, near-equal ones once."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)
    )
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    @F.pandas_udf("long")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([near_key(t or "") for t in texts], dtype="int64")

    # SAMPLE rows of two numbers bound what is broadcast.
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    once = joined.withColumn("near", keys("text")).groupBy("near").agg(F.max_by(F.struct("toxic", "text"), F.struct("toxic", "doc_id")).alias("row"))
    return materialize(once.select("row.toxic", "row.text"), "toxicity-sample")


def likelihood_ratio(pos, neg, toxic: int, clean: int):
    """The G-squared statistic of a stem in pos of toxic and neg of clean documents."""
    n, k = toxic + clean, pos + neg

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    return 2 * (term(pos, k * toxic / n) + term(neg, k * clean / n) + term(toxic - pos, (n - k) * toxic / n) + term(clean - neg, (n - k) * clean / n))


def learn_stems(sample: DataFrame, toxic: int, clean: int) -> list[str]:
    """The prefixes that tell most about the label, at most MOST_STEMS."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: dict[str, list[int]] = {}
            for y, text in zip(frame["toxic"], frame["text"]):
                words = set(WORDS.findall((text or "").lower()))
                for p in {w[:n] for w in words for n in PREFIXES if len(w) >= n}:
                    seen.setdefault(p, [0, 0])[1 if y else 0] += 1
            yield pd.DataFrame({"stem": list(seen), "pos": [v[1] for v in seen.values()], "neg": [v[0] for v in seen.values()]})

    least = max(LEAST_SUPPORT, math.ceil(0.01 * toxic))
    pos, neg = F.col("pos"), F.col("neg")
    found = (
        sample.select("toxic", "text")
        .mapInPandas(count, "stem string, pos long, neg long")
        .groupBy("stem")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where((pos >= least) & (pos / toxic > LEAST_RATIO * (neg + 0.5) / clean))
        .withColumn("g2", likelihood_ratio(pos, neg, toxic, clean))
        .where(F.col("g2") >= LEAST_G2)
        .orderBy(F.desc("g2"), "stem")
        .limit(MOST_STEMS)
        .collect()
    )
    return [r["stem"] for r in found]


def fit_weights(x: np.ndarray, fixed: np.ndarray, y: np.ndarray, l2: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method, with fixed an offset; l2 holds each weight to its prior, the intercept is last."""
    design = np.c_[x, np.ones(len(x))]
    w, ridge, center = np.append(prior, 0.0), np.append(l2, 1e-3), np.append(prior, 0.0)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w + fixed, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge + 1e-9)
        step = np.clip(np.linalg.solve(hess, design.T @ (p - y) + ridge * (w - center)), -3, 3)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fitted(rows: list, stems: list[str], factors: tuple[float, ...] | None = None) -> Model:
    """Weights of stems first, under the prior factors of patterns; then factors, given the weights. factors holds them fixed instead."""
    prior = np.array(prior_factors() if factors is None else factors)
    y = np.array([r["toxic"] != 0 for r in rows], float)
    length = np.array([word_scale(r["words"]) for r in rows])
    x, fixed = np.zeros((len(rows), len(stems) + 1)), np.zeros((len(rows), len(prior)))
    for i, r in enumerate(rows):
        for stem, p, n in zip(r["stems"], r["patterns"], r["counts"]):
            x[i, stem] += prior[p] * n
        fixed[i, r["fixed_patterns"]] = r["fixed"]
    x[:, -1] = length
    w = fit_weights(x, fixed @ prior, y, np.full(x.shape[1], 0.5), np.zeros(x.shape[1]))
    if factors is None:
        by_pattern = fixed.copy()
        for i, r in enumerate(rows):
            for stem, p, n in zip(r["stems"], r["patterns"], r["counts"]):
                by_pattern[i, p] += w[stem] * n
        # Patterns that the sample hardly shows stay as they were, and what all have in common is left to the weights.
        # Factors are held to a range, then length and intercept follow.
        energy = (by_pattern**2).sum(axis=0)
        ridge = np.append(1.0 + FACTOR_RIDGE * energy, 0.5)
        told = fit_weights(np.c_[by_pattern, length], np.zeros(len(rows)), y, ridge, np.append(prior, w[-2]))[: len(prior)]
        common = float((told * prior * energy).sum() / max((prior * prior * energy).sum(), 1e-12)) or 1.0
        prior = np.clip(np.where(energy > 0, told / common, prior), 0.0, 2.0)
        w[-2:] = fit_weights(length[:, None], by_pattern @ prior, y, np.array([0.5]), w[-2:-1])
    return Model({stem: float(v) for stem, v in zip(stems, w)}, float(w[-2]), float(w[-1]), tuple(prior.tolist()))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list, list[str]]:
    """The sample's rows as counts of stems by pattern, and the stems; nothing without labels of both kinds."""
    sample = training_sample(docs, labels)
    kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sum(n for k, n in kinds.items() if k), kinds.get(0, 0)
    if not toxic or not clean:
        return [], []
    stems = learn_stems(sample, toxic, clean)
    raw = Model(dict.fromkeys(stems, 1.0), 0.0, 0.0)
    number = {stem: k for k, stem in enumerate(stems)}

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = raw.lexicon
        for frame in frames:
            out = []
            for y, text in zip(frame["toxic"], frame["text"]):
                words, fixed, counts = own.features(text or "")
                told = sorted((number[stem], p, n) for (stem, p), n in counts.items())
                out.append((y, words, sorted(fixed), [fixed[p] for p in sorted(fixed)], *([t[k] for t in told] for k in range(3))))
            yield pd.DataFrame(out, columns=["toxic", "words", "fixed_patterns", "fixed", "stems", "patterns", "counts"])

    # At most SAMPLE rows of a few numbers each; ordered, so that reruns add up alike.
    schema = "toxic int, words long, fixed_patterns array<int>, fixed array<double>, stems array<int>, patterns array<int>, counts array<long>"
    rows = sample.select("toxic", "text").mapInPandas(features, schema).collect()
    return sorted(rows, key=tuple), stems


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows, stems = training_rows(docs, labels)
    return fitted(rows, stems) if rows else Model({}, 0.0, PRIOR_INTERCEPT)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "score": [model.score(t or "") for t in frame["text"]]})

    scored = narrow.withColumn("id", F.col("id").cast("string")).mapInPandas(run, "id string, score double")
    doc_id = F.col("id").cast("long")
    return scored.select(doc_id.alias("doc_id"), (fold(doc_id) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text is predicted toxic; all columns stay."""
    model = learn(docs, labels)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "") for t in texts], dtype=float)

    return docs.where(scored(F.col("text").cast("string")) < 0.5)
