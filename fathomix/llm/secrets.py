"""Operator 9: secret scans by a linear-chain conditional random field.

Three fixed patterns give the base spans. Beside them a CRF tags every token of a
text as secret begin (B), inside (I) or outside (O) from the token's shape, its
neighbouring words, the distance to a keyword and features of its file, decoded by
Viterbi over the whole text. It is trained here, on the base spans of a bounded
sample of documents as labels and on the fixed sentences of seed_windows(), which
hold secrets without the patterns' forms and keywords without a secret; the patterns
themselves are no features.

A stretch of B and I raises the best path only if its scores outweigh those of O, so
tokens in no stretch whose bounds sum to zero or more are certainly O. Only what is
left is decoded one by one, and the result is that of decoding the whole text.

A token is a run of letters, digits and +/_.=@- (without dots, @ and hyphens at its end),
so a secret with other marks is found in parts, if at all.

Defined results: a null text counts as empty and has no spans; a null id stays
null; equal rows get equal spans; overlapping spans of one kind cannot occur, and
a CRF span that overlaps a base span is part of that one and not listed; without
any labelled token the CRF knows the fixed sentences only; an empty table gives no
rows. Columns other than doc_id and text are not carried by the scan; redaction
keeps all.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fathomix.llm.common import materialize

#: Kinds in their order, and the base patterns.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

LETTERS = "A-Za-z0-9_\u00c0-\u024f"
#: What may stand between a keyword and its value, then the token itself; other scripts' words stand alone.
LEAD = re.compile(r"""(?:[:=]\x20{0,2})?["'`]?""")
TOKEN = re.compile(rf"""{LEAD.pattern}[+/-]{{0,2}}[{LETTERS}](?:[{LETTERS}+/.@-]*[{LETTERS}+/])?(?:={{1,2}}(?![{LETTERS}"'`]))?|[^\W\x00-\u024f]+""")
#: Hashed features, and how many tokens back a keyword is looked for.
FEATURES, KEY_REACH = 1 << 16, 4
#: Documents of which at most this many windows, from at most this many documents, train the model; tokens of a window.
TRAIN_DOCS, TRAIN_WINDOWS, WINDOW = 20_000, 18_000, 12
#: Characters that are scored at once, and tokens whose scores are kept.
BLOCK, KEPT = 500_000, 200_000
O, B, I = 0, 1, 2
_NEVER = -1e9


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself), by start, then kind."""
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def chains(text: str) -> list[list[tuple[int, int]]]:
    """All tokens of the text as one chain; none without tokens."""
    run = [(LEAD.match(text, m.start()).end(), m.end()) for m in TOKEN.finditer(text)]
    return [run] if run else []


_CLASSES = str.maketrans({**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), **dict.fromkeys("0123456789", "0")})
_REPEATS = re.compile(r"(.)\1+")
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}", re.IGNORECASE)
_KEY = re.compile("|".join(KEYWORDS), re.IGNORECASE)
_DIGIT = re.compile(r"[0-9]")
_HEXES = re.compile(r"[0-9a-fA-F]+")


def shape(token: str) -> str:
    """Character classes, runs shortened to two, eight at most."""
    return _REPEATS.sub(r"\1\1", token.translate(_CLASSES))[:8]


@lru_cache(maxsize=50_000)
def _hashed(name: str) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


def signature(lead: str, token: str) -> tuple:
    """What a token and the mark before it say by themselves, one value a feature; most tokens share theirs with others."""
    n = len(token)
    if not lead and n > 1 and _PLAIN.fullmatch(token):
        return plain_signature(token, n)
    classes = token.translate(_CLASSES)
    digits, upper, lower = classes.count("0"), classes.count("A"), classes.count("a")
    squeezed = _REPEATS.sub(r"\1\1", classes)
    length = min(n // 4, 10)
    return (
        "bias",
        squeezed[:8],
        length,
        ((digits > 0) + (upper > 0) + (lower > 0), length),
        (8 * len(set(token)) // n, length),
        8 * digits // n,
        digits > 0 and lower + upper > 0,
        (n >= 8 and digits > 0 and _HEXES.fullmatch(token) is not None, upper > 0),
        min(4, squeezed.count("aA")),
        _CONSONANTS.search(token) is not None,
        n - digits - upper - lower > 0,
        "@" in token and "." in token.partition("@")[2],
        token[:4] if upper >= 4 and token[:4].isupper() and token[:4].isalpha() else squeezed[:4],
        lead.replace(" ", ""),
    )


_PLAIN = re.compile("[a-z]+")


def plain_signature(token: str, n: int) -> tuple:
    """signature() of a word in small letters, which most tokens are."""
    length = min(n // 4, 10)
    return ("bias", "aa", length, (1, length), (8 * len(set(token)) // n, length), 0, False, (False, False), 0, _CONSONANTS.search(token) is not None, False, False, "aa", "")


def own_features(signed: tuple) -> list[int]:
    return [_hashed(f"own{i}={v}") for i, v in enumerate(signed)]


def context_hash(token: str) -> int:
    """A neighbour as a feature, to which its role is added: in lower case, without marks around it, all numbers alike."""
    word = "0" if _DIGIT.search(token) else token.strip("+/_.=-").lower()
    return crc32(word.encode("utf-8", "surrogatepass"))


def is_key(token: str) -> bool:
    return _KEY.search(token) is not None


#: Roles of a neighbour: where it stands, and what is added to its hash.
ROLES = ((-1, 0), (-2, 20_011), (1, 40_009))


def sequence_features(words: list[tuple[str, str]], about: list[str], at: range | None = None) -> list[list[int]]:
    """Of each of the (lead, token) in words, or of those at some places only."""
    fixed = [_hashed(x) for x in about]
    out = []
    for j in at if at is not None else range(len(words)):
        f = own_features(signature(*words[j]))
        f += [(context_hash(words[j + d][1]) + role) % FEATURES for d, role in ROLES if 0 <= j + d < len(words)]
        f += [_hashed(f"key{k}") for k in range(1, KEY_REACH + 1) if j >= k and is_key(words[j - k][1])]
        out.append(f + fixed)
    return out


def split_lead(match: str) -> tuple[str, str]:
    if match[0].isalnum():
        return "", match
    at = LEAD.match(match).end()
    return match[:at], match[at:]


def token_features(text: str, s: int, e: int, file_features: list[str]) -> list[int]:
    """Of one token, by the texts around it."""
    words = [split_lead(m) for m in TOKEN.findall(text)]
    return sequence_features(words, file_features, range(at := chains(text)[0].index((s, e)), at + 1))[0]


def file_features(text: str, runs: list[list[tuple[int, int]]] | None = None) -> list[str]:
    lower = text.lower()
    return [f"file-key={any(k in lower for k in KEYWORDS)}", f"file-size={len(text).bit_length()}"]


def silver_tags(run: list[tuple[int, int]], base: list[tuple[int, int, int, int]]) -> list[int]:
    """Tags of a run by the base spans: B where a secret begins, I where it goes on."""
    secrets: list[list[int]] = []
    for start, end in sorted((start, end) for _, _, end, start in base):
        if secrets and start < secrets[-1][1]:
            secrets[-1][1] = max(end, secrets[-1][1])
        else:
            secrets.append([start, end])
    tags, inside, k = [], None, 0
    for s, e in run:
        while k < len(secrets) and secrets[k][1] <= s:
            k += 1
        hit = k if k < len(secrets) and secrets[k][0] < e else None
        tags.append(O if hit is None else I if hit == inside else B)
        inside = hit
    return tags


def seed_windows() -> list[tuple[list[tuple[str, str]], list[int]]]:
    """Fixed sentences with tags: values of many forms after a keyword and a verb or sign, keywords without a value, keys told by their shape alone, and long tokens that are none."""
    rng = random.Random(9)
    common = "the my new old a this our please use with for account server user login now and then today it here said note that in of to on was very much also still about".split()
    names = "correct horse battery staple hunter dragon summer winter purple monkey river silver garden coffee orange letter castle planet shadow rocket".split()
    plain = "reset required wrong expired invalid incorrect changed forgotten missing needed strong weak unknown safe protected stored rotated important mandatory different generated authentication documentation available unfortunately".split()
    letters = "abcdefghijklmnopqrstuvwxyz"

    def value() -> str:
        form = rng.randrange(9)
        if form < 2:
            return "".join(rng.choice(names).title() for _ in range(rng.randrange(2, 5)))
        if form < 4:
            return rng.choice([rng.choice(names), rng.choice(names).title()]) + str(rng.randrange(10 ** rng.randrange(1, 5)))
        pool = [letters, letters + letters.upper(), letters + letters.upper() + "0123456789", "0123456789ABCDEF"][max(0, form - 5)]
        return "".join(rng.choice(pool) for _ in range(rng.randrange(10, 33)))

    def unnamed() -> str:
        mixed = letters + letters.upper() + "0123456789"
        body = "".join(rng.choice(["0123456789ABCDEF", mixed, mixed, mixed + "+/"][rng.randrange(4)]) for _ in range(rng.randrange(28, 49)))
        body = body if rng.random() < 0.6 else "".join(rng.choice("0123456789ABCDEF") for _ in range(rng.randrange(28, 49)))
        prefix = "".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) + rng.choice("_-")
        return (prefix if rng.random() < 0.35 else "") + body.strip("+/") + "x"

    def ordinary() -> str:
        digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
        form = rng.randrange(7)
        if form == 0:
            return digits(rng.randrange(6, 25))
        if form == 1:
            return f"{digits(3)}-{digits(rng.randrange(3, 5))}-{digits(4)}"
        if form == 2:
            return "-".join(hexes(n) for n in (8, 4, 4, 4, 12))
        if form == 3:
            return ".".join(str(rng.randrange(256)) for _ in range(4))
        if form == 4:
            return f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}"
        if form == 5:
            return "".join(rng.choice(names + common + plain) for _ in range(rng.randrange(3, 6)))
        return "/".join(rng.choice(names + common) for _ in range(rng.randrange(3, 6))) + rng.choice([".html", ".txt", "/" + digits(3), ""])

    out = []
    for i in range(2400):
        key = rng.choice(["password", "passwd", "secret", "token", "apikey", "api_key", "secret key", "access token", "Password", "Secret"]).split()
        link = rng.choice([["is"], ["was"], [], ["is", "now"], ["="], [":"]])
        before = [rng.choice(common) for _ in range(rng.randrange(0, 6))]
        after = [rng.choice(common) for _ in range(rng.randrange(0, 4))]
        if i % 2:
            end, tags = [value()], [B]
        else:
            end = [*(["not"] if rng.random() < 0.2 else []), *(["too"] if rng.random() < 0.1 else []), rng.choice(plain + common)]
            tags = [O] * len(end)
            link = [] if link in (["="], [":"]) else link
        sign = link[0] if link in (["="], [":"]) else ""
        middle = [] if sign else link
        words = [("", w) for w in before + key + middle] + [(sign, end[0])] + [("", w) for w in end[1:] + after]
        n = len(before) + len(key) + len(middle)
        out.append((words, [O] * n + tags + [O] * len(after)))
        if i % 4 == 1:  # letters with nothing near that calls them a secret
            words = [("", w) for w in before] + [("", end[0] if end[0].isalpha() else rng.choice(names + common + plain))] + [("", w) for w in after]
            out.append((words, [O] * len(words)))
        if i % 2 == 0:  # values that are told by their shape alone, and long tokens that are none
            told = unnamed() if i % 4 == 0 else ordinary()
            words = [("", w) for w in [*before, told, *after]]
            out.append((words, [O] * len(before) + [B if i % 4 == 0 else O] + [O] * len(after)))
    return out


@dataclass
class CRF:
    """emission: (FEATURES, 3); transition: (3, 3), from row to column; start: (3,)."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def viterbi(self, features: list[list[int]]) -> list[int]:
        return best_path([self.emission[f].sum(axis=0) for f in features], self.transition, self.start)


def best_path(scores: list[np.ndarray], transition: np.ndarray, start: np.ndarray, end: np.ndarray | float = 0.0) -> list[int]:
    best = scores[0] + start
    back = []
    for s in scores[1:]:
        paths = best[:, None] + transition
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + s
    at = int((best + end).argmax())
    tags = [at]
    for pointers in reversed(back):
        at = int(pointers[at])
        tags.append(at)
    return tags[::-1]


class Tagger:
    """Tags whole texts by a CRF; scores of tokens are kept by their text.

    A row holds, for B and I less those of O, what a token scores itself and adds as
    a neighbour in each role; the last column says whether it is a keyword.
    """

    def __init__(self, model: CRF) -> None:
        self.model = model
        self.gains = model.emission[:, 1:] - model.emission[:, :1]
        self.keys = [self.gains[_hashed(f"key{k}")] for k in range(1, KEY_REACH + 1)]
        t, stay = model.transition, model.transition[O, O]
        #: The most that transitions can add for a token of a stretch of B and I, its end included.
        self.bound = max(float((t[:, 1:] - stay).max()), float((model.start[1:] - model.start[O]).max())) + max(0.0, float((t[1:, O] - stay).max()))
        self.near = np.concatenate([np.roll(self.gains, -role, axis=0) for _, role in ROLES], axis=1)
        self.signs: dict[tuple, tuple[float, float]] = {}
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {"": 0}
        self.rows = np.zeros((1, 9))
        self.new: list[tuple[float, float, int, bool]] = []

    def number(self, match: str) -> int:
        i = self.ids[match] = len(self.ids)
        lead, token = split_lead(match)
        signed = signature(lead, token)
        own = self.signs.get(signed)
        if own is None:
            if len(self.signs) >= KEPT:
                self.signs.clear()
            own = self.signs[signed] = tuple(self.gains[own_features(signed)].sum(axis=0).tolist())
        self.new.append((*own, context_hash(token) % FEATURES, len(token) > 4 and is_key(token)))
        return i

    def settle(self) -> None:
        """Rows of the tokens that have been numbered since."""
        if self.new:
            new = np.array(self.new, dtype=float)
            self.rows = np.concatenate([self.rows, np.concatenate([new[:, :2], self.near[new[:, 2].astype(int)], new[:, 3:]], axis=1)])
            self.new = []

    def tags(self, texts: list[str]) -> Iterator[list[tuple[int, int]]]:
        """(token, tag) of each token of each text that is not O."""
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK:
                yield from self._tags(block)
                block, size = [], 0
        yield from self._tags(block)

    def _tags(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        if len(self.ids) > KEPT:
            self.forget()
        # KEY_REACH empty tokens stand between texts, so that none is a neighbour of another text's.
        ids, begins, counts, about, known = [0] * KEY_REACH, [], [], [], self.ids
        for text in texts:
            found = TOKEN.findall(text)
            begins.append(len(ids))
            counts.append(len(found))
            about.append(self.gains[[_hashed(x) for x in file_features(text)]].sum(axis=0))
            ids += [known[x] if x in known else self.number(x) for x in found]
            ids += [0] * KEY_REACH
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not sum(counts):
            return out
        self.settle()
        ids, counts = np.array(ids), np.array(counts)
        scores = self.rows[ids, :2]
        for k, (d, _) in enumerate(ROLES, 1):
            near = self.rows[ids, 2 * k : 2 * k + 2]
            if d < 0:
                scores[-d:] += near[:d]
            else:
                scores[:-d] += near[d:]
        keys = np.flatnonzero(self.rows[ids, 8])
        for k, gain in enumerate(self.keys, 1):
            scores[keys + k] += gain
        real = ids > 0
        scores[real] += np.repeat(np.array(about), counts, axis=0)
        most = np.where(real, scores.max(axis=1) + self.bound, -1e6)
        total = np.concatenate([[0.0], np.cumsum(most)])
        before = total[1:] - np.minimum.accumulate(total)[:-1]
        after = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        at = np.flatnonzero(real & (before + after - most >= -1e-3))
        first = np.array(begins)
        for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
            i, j = int(part[0]), int(part[-1]) + 1
            doc = int(np.searchsorted(first, i, side="right")) - 1
            start = self.model.start if i == first[doc] else self.model.transition[O]
            end = 0.0 if j == first[doc] + counts[doc] else self.model.transition[:, O]
            path = best_path([np.array([0.0, *x]) for x in scores[i:j]], self.model.transition, start, end)
            out[doc] += [(i + k - int(first[doc]), tag) for k, tag in enumerate(path) if tag != O]
        return out


def train_crf(sequences: list[list[list[int]]], tags: list[list[int]], rounds: int = 120, rate: float = 0.15, l2: float = 1e-4) -> CRF | None:
    """Maximum conditional likelihood by Adam over all sequences at once; None without any secret."""
    if not any(B in t for t in tags):
        return None
    n, length, width = len(sequences), max(map(len, sequences)), max(len(f) for s in sequences for f in s)
    feats = np.full((n, length, width), FEATURES, np.int32)
    gold = np.zeros((n, length), np.int64)
    mask = np.zeros((n, length), bool)
    for i, (seq, t) in enumerate(zip(sequences, tags)):
        for j, f in enumerate(seq):
            feats[i, j, : len(f)] = f
            gold[i, j], mask[i, j] = t[j], True
    allowed = np.zeros((3, 3))
    allowed[O, I] = _NEVER
    first = np.array([0.0, 0.0, _NEVER])
    params = [np.zeros((FEATURES + 1, 3)), np.zeros((3, 3)), np.zeros(3)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    flat = np.ascontiguousarray(feats[mask].T)
    onehot = np.eye(3)[gold] * mask[..., None]
    pairs = mask[:, 1:]
    seen_pairs = np.einsum("nla,nlb->ab", onehot[:, :-1] * pairs[..., None], onehot[:, 1:])

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, rounds + 1):
        emission, transition, start = params
        e = np.zeros((n, length, 3))
        e[mask] = sum(emission[f] for f in flat)
        t = transition + allowed
        forward = np.empty((n, length, 3))
        forward[:, 0] = e[:, 0] + start + first
        for j in range(1, length):
            moved = lse(forward[:, j - 1, :, None] + t, 1) + e[:, j]
            forward[:, j] = np.where(mask[:, j, None], moved, forward[:, j - 1])
        z = lse(forward[:, -1], 1)
        backward = np.zeros((n, length, 3))
        for j in range(length - 2, -1, -1):
            moved = lse(t + (e[:, j + 1] + backward[:, j + 1])[:, None, :], 2)
            backward[:, j] = np.where(mask[:, j + 1, None], moved, 0.0)
        unary = np.exp(forward + backward - z[:, None, None]) * mask[..., None]
        diff = unary - onehot
        grad_e = np.zeros_like(emission)
        for tag in range(3):
            grad_e[:, tag] = np.bincount(flat.ravel(), np.tile(diff[mask][:, tag], width), FEATURES + 1)
        grad_e[FEATURES] = 0
        grad_t = -seen_pairs
        if length > 1:
            joint = np.exp(forward[:, :-1, :, None] + t + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None])
            grad_t = grad_t + (joint * pairs[..., None, None]).sum(axis=(0, 1))
        grads = [grad_e / n, grad_t / n, diff[:, 0].sum(axis=0) / n]
        for k, (p, g) in enumerate(zip(params, grads)):
            g = g + l2 * p
            m, v = moments[k]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return CRF(params[0][:FEATURES], params[1] + allowed, params[2] + first)


def all_spans(text: str, model: CRF | None) -> list[tuple[int, int, int, int]]:
    """Base spans and the CRF's further ones, by start, then kind."""
    return next(spans_of([text], model and Tagger(model)))


def spans_of(texts: list[str], tagger: Tagger | None) -> Iterator[list[tuple[int, int, int, int]]]:
    """all_spans() of each text."""
    for text, tags in zip(texts, tagger.tags(texts) if tagger else [[]] * len(texts)):
        base = base_spans(text)
        if not tags:
            yield base
            continue
        run, more = chains(text)[0], []
        for j, tag in tags:
            s, e = run[j]
            if tag == I and more:
                more[-1] = (more[-1][0], 3, e, more[-1][3])
            else:
                more.append((s, 3, e, s))
        yield sorted(base + outside(more, base))


def outside(spans: list[tuple[int, int, int, int]], base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans that overlap no base span; both by start."""
    out, k, reach = [], 0, 0
    for span in spans:
        while k < len(base) and base[k][0] < span[2]:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= span[0]:
            out.append(span)
    return out


def masked_keys(words: list[str], tags: list[int], named: list[bool]) -> tuple[list[str], list[int]]:
    """A window without its keywords, and its secrets without the marks before them, so that shape must tell."""
    kept = [(split_lead(w)[1] if t else w, t) for w, t, key in zip(words, tags, named or [False] * len(words)) if t or not key]
    return [w for w, _ in kept], [t for _, t in kept]


def training_rows(docs: DataFrame) -> DataFrame:
    """Windows of tokens, with leads, and their tags from a sample of at most about TRAIN_DOCS documents.

    The sample is fixed by a hash of the id, so reruns agree; the rest of the
    table is not sampled anywhere. A keyword without a base span near it is no
    proof of either kind, so its window is left to the fixed sentences. Of the other
    windows without a secret a fixed part is taken by a hash of their words. A window
    with a secret is there twice, with and without its keywords. kind is 0
    with a secret, 1 with a digit, else 2.
    """
    rows = max(1, docs.count())
    share = min(1.0, TRAIN_DOCS / rows)
    chosen = docs if share == 1.0 else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame["text"]:
                found, base = TOKEN.findall(text), base_spans(text)
                about = file_features(text)
                tags = silver_tags(chains(text)[0], base) if base and found else [O] * len(found)
                named = list(map(is_key, found)) if about[0] == "file-key=True" else []
                for i in range(0, len(found), WINDOW):
                    part = tags[i : i + WINDOW]
                    words = found[i : i + WINDOW]
                    if any(part):
                        kind = 0
                    elif any(named[max(0, i - KEY_REACH) : i + WINDOW]):
                        continue
                    else:
                        joined = " ".join(words)
                        kind = 1 if _DIGIT.search(joined) else 2
                        if crc32(joined.encode("utf-8", "surrogatepass")) % (1, 4, 16)[kind]:
                            continue
                    out.append((kind, words, part, about))
                    if kind == 0:
                        out.append((kind, *masked_keys(words, part, named[i : i + WINDOW]), about))
            yield pd.DataFrame(out, columns=["kind", "words", "tags", "about"])

    text = F.col("text").cast("string")
    return chosen.where(text != "").select(text.alias("text")).mapInPandas(run, "kind int, words array<string>, tags array<int>, about array<string>")


def fit(docs: DataFrame) -> CRF | None:
    """Trains on the sample and the fixed sentences; what reaches the driver is bounded by TRAIN_WINDOWS, a third for each kind of window."""
    rows = materialize(training_rows(docs), "secrets-windows").distinct().withColumn("at", F.xxhash64("words", "tags", "about"))
    kept = [rows.where(F.col("kind") == k).orderBy("at").limit(TRAIN_WINDOWS // 3).collect() for k in range(3)]
    sequences, tags = [], []
    for r in (r for part in kept for r in part):
        sequences.append(sequence_features([split_lead(w) for w in r["words"]], r["about"]))
        tags.append(list(r["tags"]))
    for words, t in seed_windows():
        sequences.append(sequence_features(words, []))
        tags.append(t)
    return train_crf(sequences, tags, rounds=80)


def scan(docs: DataFrame, model: CRF | None) -> DataFrame:
    """(doc_id, spans array of (kind, start, end, secret_start)) of every whole text."""
    narrow = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = model and Tagger(model)
        for frame in frames:
            found = [[{"kind": KINDS[k], "start": s, "end": e, "secret_start": v} for s, k, e, v in spans] for spans in spans_of([t or "" for t in frame["text"]], tagger)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "spans": found})

    schema = "doc_id string, spans array<struct<kind string, start int, end int, secret_start int>>"
    return narrow.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def span_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text."""
    found = scan(docs, fit(docs))
    base = F.filter("spans", lambda s: s["kind"] != "crf")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mask and n_chars, if there, counted anew.

    Of an assignment only the value goes. All columns and rows stay.
    """
    model = fit(docs)
    columns = docs.columns

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = model and Tagger(model)
        for texts in batches:
            yield masked(texts, tagger)

    def masked(texts: pd.Series, tagger: Tagger | None) -> pd.Series:
        out = []
        for text, spans in zip(texts, spans_of([t or "" for t in texts], tagger)):
            if text is None:
                out.append(None)
                continue
            at, parts = 0, []
            for _, _, end, secret in spans:
                if end > at:
                    parts += [text[at : max(at, secret)], mask]
                    at = end
            out.append("".join([*parts, text[at:]]) if parts else text)
        return pd.Series(out, dtype=object)

    redacted = docs.withColumn("text", cleaned(F.col("text").cast("string")))
    if "n_chars" in columns:
        redacted = redacted.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return redacted.select(*columns)
