"""Operator 10: byte-level BPE encoding and decoding by a contiguous rank array.

A short word is held as two parallel lists: the boundaries of its parts and, for
each adjacent pair, the rank its merge has in the vocabulary. Merging scans the
rank list for its minimum, deletes one boundary and refreshes the two
neighbouring ranks. Words repeat, so a worker keeps a bounded cache from a
blank-separated chunk of text to its ids. New words of many texts are merged
together: those of as many parts are the rows of one rank array, of which each
loses one boundary in a step.

Defined results: a null text counts as empty; an empty text has no ids; special
token strings in a text become their special id, as in the tokenizers library.
Very long words take the same path (cost grows with the square of one word's
length, so words over LONG_WORD bytes use a heap instead, with equal results).
Rows are independent, so ties, repeated rows, empty tables and further columns
need no care; further columns with the operator's own names are not carried.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from fathomix.llm.chunk_cache import GenerationCache

#: White space as the vocabulary's pattern means it, and that pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Bytes of a word from which the heap takes over from the scan.
LONG_WORD = 256
#: Chunks, and as many words, that a worker's caches hold in each generation.
CACHE_HALF = 150_000
#: Longer chunks are encoded without being cached.
CACHE_CHUNK = 64
#: Bytes of the longest words that are merged together; texts of which that is done at once, and their characters, about, at most.
TOGETHER, TEXTS, CHARS = 32, 512, 2_000_000
#: Chunks that are surely one word: letters of the Latin blocks after a blank at most.
_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")

_NONE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankBPE:
    """Encoder and decoder of one byte-level BPE vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str, cache_half: int = CACHE_HALF) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        model = spec["model"]
        to_bytes = {token: bytes(back[c] for c in token) for token in model["vocab"]}
        self.byte_id = {raw[0]: model["vocab"][t] for t, raw in to_bytes.items() if len(raw) == 1}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        vocab = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = to_bytes[token]
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self._words = regex.compile(PATTERN)
        self._split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: A blank that ends a run of white space and is not followed by a word: chunks would not be independent.
        self._unsafe = regex.compile(rf"[{SPACE}] (?:[{SPACE}]|$)")
        self._cache = GenerationCache(self._chunk, cache_half)
        self._word_cache = GenerationCache(self._word, cache_half)
        self.decimal = list(map(str, range(size)))
        # Of merges: their pairs in ascending order, as first * size + second, with their ranks; what each rank makes.
        pairs = sorted((a * size + b, rank) for (a, b), (rank, _) in self.merge.items())
        self._pairs, self._ranks = (np.array([p[k] for p in pairs] + [-1] * (not pairs), np.int64) for k in (0, 1))
        self._made = np.zeros(len(model["merges"]), np.int64)
        for rank, new in self.merge.values():
            self._made[rank] = new
        self._byte_ids = np.array([self.byte_id.get(b, -1) for b in range(256)], np.int64)
        self._byte_ranks = self._rank(self._byte_ids[:, None], self._byte_ids[None, :])
        self._ids = np.array(range(size), dtype=object)

    def merge_word(self, raw: bytes) -> list[int]:
        """Ids of one word's bytes: lowest rank first, leftmost of equals first."""
        ids = [self.byte_id[b] for b in raw]
        if len(ids) < 2:
            return ids
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        merge = self.merge
        none = (_NONE, 0)
        pairs = [merge.get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best[0] == _NONE:
                break
            i = pairs.index(best)
            ids[i] = best[1]
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = merge.get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = merge.get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else -1
            if j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := self.merge.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m[0], a, m[1], ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs, _NONE where they do not merge."""
        key = a * len(self.token_bytes) + b
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._ranks[at], _NONE)

    def merge_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """merge_word() of each word, not empty.

        Words of as many parts are the rows of an array. A step merges one pair of each row
        and so leaves rows of one part less, which join the words that have that many.
        """
        out: list[tuple[int, ...]] = [()] * len(words)
        by_length: dict[int, list[int]] = {}
        whole = (self._byte_ids >= 0).all()
        for i, word in enumerate(words):
            if whole and len(word) <= TOGETHER:
                by_length.setdefault(len(word), []).append(i)
            else:
                out[i] = tuple(self.merge_word(word))
        at, ids, ranks = np.empty(0, np.int64), np.empty((0, TOGETHER), np.int64), np.empty((0, TOGETHER - 1), np.int64)
        for n in range(TOGETHER, 0, -1):
            if own := by_length.get(n):
                raw = np.frombuffer(b"".join([words[i] for i in own]), np.uint8).reshape(len(own), n)
                at = np.concatenate([at, own])
                ids = np.concatenate([ids, self._byte_ids[raw]])
                ranks = np.concatenate([ranks, self._byte_ranks[raw[:, :-1], raw[:, 1:]]])
            best = ranks.argmin(axis=1) if n > 1 and len(at) else np.zeros(len(at), np.int64)
            low = ranks[np.arange(len(at)), best] if n > 1 else np.full(len(at), _NONE)
            done = low == _NONE
            for i, row in zip(at[done].tolist(), self._ids[ids[done]].tolist()):
                out[i] = tuple(row)
            if n == 1:
                break
            at, ids, ranks, best, low = (x[~done] for x in (at, ids, ranks, best, low))
            row = np.arange(len(at))
            keep = np.ones(ids.shape, bool)
            keep[row, best + 1] = False
            ids = ids[keep].reshape(len(at), n - 1)
            ids[row, best] = self._made[low]
            keep = np.ones(ranks.shape, bool)
            keep[row, best] = False
            ranks = ranks[keep].reshape(len(at), n - 2)
            for d in (-1, 0):  # the pairs that end and begin with what was made
                near = np.flatnonzero((best + d >= 0) & (best + d < n - 2))
                j = best[near] + d
                ranks[near, j] = self._rank(ids[near, j], ids[near, j + 1])
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        return tuple(self.merge_word(word.encode("utf-8", "surrogatepass")))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for word in self._words.findall(chunk):
            out += self._word_cache[word] if len(word) <= CACHE_CHUNK else self._word(word)
        return tuple(out)

    def _chunks(self, text: str) -> list[str] | None:
        """A text's chunks; nothing if they would not be independent."""
        if self._unsafe.search(text):
            return None
        first, *rest = text.split(" ")
        return [first, *[" " + part for part in rest]] if first else [" " + part for part in rest]

    def _joined(self, chunks: list[str]) -> list[int]:
        out: list[int] = []
        cache = self._cache
        for chunk in chunks:
            out += cache[chunk] if len(chunk) <= CACHE_CHUNK else self._chunk(chunk)
        return out

    def _plain(self, text: str) -> list[int]:
        chunks = self._chunks(text)
        return list(self._chunk(text)) if chunks is None else self._joined(chunks)

    def _meet(self, chunks: set[str]) -> None:
        """Puts into the caches what of chunks they lack."""
        cache, known, old = self._cache, self._word_cache, self._cache.old
        new = [chunk for chunk in chunks if chunk not in cache and chunk not in old and len(chunk) <= CACHE_CHUNK]
        is_word, find = _WORD.fullmatch, self._words.findall
        split = {chunk: find(chunk) for chunk in new if not is_word(chunk)}
        alone = [chunk for chunk in new if chunk not in split]
        words = list(dict.fromkeys(w for parts in split.values() for w in parts))
        met = {w: known[w] for w in words if w in known or w in known.old}
        words = [w for w in words if w not in met]
        merged = self.merge_words([w.encode("utf-8", "surrogatepass") for w in alone + words])
        cache.put_all(dict(zip(alone, merged)))
        fresh = dict(zip(words, merged[len(alone) :]))
        known.put_all(fresh)
        met |= fresh
        cache.put_all({chunk: met[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable([met[w] for w in parts])) for chunk, parts in split.items()})

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """encode() of each text; the words that the caches lack are merged together, those of some texts at once."""
        for part in self._parts(texts):
            on = gc.isenabled()
            gc.disable()  # what is made here has no cycles, and there is much of it
            try:
                out = self._encode_part(part)
            finally:
                if on:
                    gc.enable()
            yield from out

    @staticmethod
    def _parts(texts: list[str]) -> Iterator[list[str]]:
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if len(part) == TEXTS or size >= CHARS:
                yield part
                part, size = [], 0
        if part:
            yield part

    def _encode_part(self, texts: list[str]) -> list[list[int]]:
        listed = [None if self._has_special(text) else self._chunks(text) for text in texts]
        chunks = set().union(*filter(None, listed))
        self._meet(chunks)
        long, get = {chunk for chunk in chunks if len(chunk) > CACHE_CHUNK}, self._cache.__getitem__
        out = []
        for text, own in zip(texts, listed):
            if own is None:
                out.append(self.encode(text))
            elif long and not long.isdisjoint(own):
                out.append(self._joined(own))
            else:
                out.append(list(chain.from_iterable(map(get, own))))
        return out

    def _has_special(self, text: str) -> bool:
        return self._split_special is not None and any(s in text for s in self.special)

    def encode(self, text: str) -> list[int]:
        if not self._has_special(text):
            return self._plain(text)
        out: list[int] = []
        for piece in self._split_special.split(text):
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out += self._plain(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        table = self.token_bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, cache_half: int = CACHE_HALF) -> RankBPE:
    """One codec a worker and file; its cache lives as long as the worker."""
    return RankBPE(path, cache_half)


def _shipped(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Id and text as pandas gets them: ids as strings, as a long column with nulls would become doubles."""
    return docs.select(F.col(id_column).cast("long").cast("string").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def encode_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", decode: bool = True, cache_half: int = CACHE_HALF) -> DataFrame:
    """Encodes every whole text: (id, n_tokens long, ids array of int) and, unless decode is off, decoded string.

    cache_half: chunks, and words, of a worker's caches in each generation; where other
    operators keep caches in the same workers, fewer leave them more room.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(vocabulary, cache_half)
        for frame in frames:
            for at in range(0, len(frame), TEXTS):
                part = frame.iloc[at : at + TEXTS]
                ids = list(own.encode_all([t or "" for t in part["text"]]))
                told = {"decoded": [own.decode(x) for x in ids]} if decode else {}
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [len(x) for x in ids], "ids": ids, **told})

    schema = "doc_id string, n_tokens long, ids array<int>" + ", decoded string" * decode
    rows = _shipped(docs, id_column, text_column).mapInPandas(run, schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As encode_documents, but with digests in place of ids and text, taken in the same task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(vocabulary)
        decimal = own.decimal
        for frame in frames:
            counts, ids_sha, text_sha = [], [], []
            for ids in own.encode_all([t or "" for t in frame["text"]]):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    rows = _shipped(docs, "doc_id", "text").mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
