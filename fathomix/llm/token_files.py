"""Operator 2: token ids in fixed-width bit-packed files.

Every id takes the least bits that hold the vocabulary (16 for 49,408 ids).
A file holds the documents of one ascending range of ids:

    header   magic 'FXTOK\\x01\\0\\0', uint32 bits, uint32 ids in a block
    blocks   BLOCK ids each (the last: the rest), packed from the lowest bit up
    index    per document: int64 id, uint8 1 for a null id, uint64 end position
    offsets  uint64 byte offset of each block
    footer   uint64 documents, ids, blocks, offset of index, offset of offsets; magic

Blocks unpack by one vectorised gather, and any document is reached through its
end positions and the block offsets without reading what lies before.

Text is encoded in chunks between ASCII white space, as this vocabulary drops white
space and never merges across it. Arrow splits a batch and numbers its distinct
chunks; the library encodes all new ones as one text, told apart by the tokens that
end a word, and a bounded cache keeps them. One gather then gives the ids of the
batch. They are shipped as 16-bit integers (32-bit for larger vocabularies) and
packed once, block by block, as the file is written.

Defined results: a null text counts as empty, and a document of no text has the
end id alone; a null id sorts first; rows of one id are
ordered by hashes of their text and tokens, so repeated rows are interchangeable; an empty table gives no files and no rows.
Further columns are not carried.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from fathomix.llm import blobstore
from fathomix.llm.common import NULL_ID, materialize, new_path, placed, range_bounds, range_bucket

MAGIC = b"FXTOK\x01\0\0"
HEADER = struct.Struct("<8sII")
FOOTER = struct.Struct("<QQQQQ8s")
#: Ids in a block.
BLOCK = 65_536
#: Documents in a file, about.
FILE_DOCS = 8_192
#: Chunks, and characters of them, that a worker keeps; bytes of text it encodes together, about.
KEPT_CHUNKS, KEPT_CHARS, TOGETHER = 600_000, 16_000_000, 8_000_000

#: Fixed value: what the vocabulary's pre-tokenizer makes a word.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Marks that are no part of a contraction.
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: Beyond these letters lower case or normal form may depend on neighbours, so both are left to the library.
WIDE = "[\u0130\u0250-\U0010ffff]"
_WIDE = re.compile(WIDE)


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, bits each, from the lowest bit up; the last byte is filled with zeros.

    Eight ids fill exactly `bits` bytes; each of the eight is shifted to its place in
    those for all such groups at once.
    """
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    groups = -(-len(ids) // 8)
    lanes = np.zeros((groups, 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, bits), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        shifted = lanes[:, lane] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, byte + k] |= (shifted >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(raw: bytes, n: int, bits: int, first: int = 0) -> np.ndarray:
    """n ids from position first on, gathered from unaligned 64-bit words."""
    padded = raw + bytes(8)
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    words = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


class ChunkEncoder:
    """Encodes texts with a tokenizers file, each new chunk once.

    A known chunk is a row: a slice of `_flat`, which holds the ids of all.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.bits = bits_for(size)
        #: How ids are held and shipped until they are packed in a file.
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._ends = np.zeros(size, bool)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self._ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self._rows: dict[str, int] = {}
        self._starts, self._lengths, self._flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.kind)
        self._chars = 0

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the number of each one's."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), self.kind, int(lengths.sum())), lengths

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _library(), by one call: a chunk of k words ends at its kth word-ending token."""
        joined = " ".join(chunks)
        if not chunks or "<|" in joined or _WIDE.search(joined):
            return self._library(chunks)
        ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.kind)
        words = pc.count_substring_regex(pa.array(chunks, pa.large_string()), PIECES).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(self._ends[ids])
        last = np.cumsum(words)
        if last[-1] != len(ends) or words.min() < 1:
            return self._library(chunks)
        return ids, np.diff(ends[last - 1] + 1, prepend=0)

    def _learn(self, chunks: list[str]) -> None:
        """Adds rows for chunks that have none. Marks at a chunk's end are words of their own, so it is put together from two rows."""
        rows, parts, new = self._rows, [], dict.fromkeys(())
        whole = []
        for c in chunks:
            core = c.rstrip(MARKS)
            if core and len(core) < len(c) and core[-1].isalnum() and not _WIDE.match(core[-1]) and "<|" not in c:
                tail = c[len(core) :]
                parts.append((c, core, tail))
                new[core] = new[tail] = None
            else:
                whole.append(c)
        for c in whole:
            new[c] = None
        fresh = [c for c in new if c not in rows]
        narrow = [c for c in fresh if "<|" not in c and not _WIDE.search(c)]
        other = [c for c in fresh if "<|" in c or _WIDE.search(c)] if len(narrow) < len(fresh) else []
        for some in (narrow, other):
            self._append(some, *self._encode_chunks(some))
        if parts:
            heads = np.fromiter((rows[core] for _, core, _ in parts), np.int64, len(parts))
            tails = np.fromiter((rows[tail] for _, _, tail in parts), np.int64, len(parts))
            both = np.stack([heads, tails], axis=1).reshape(-1)
            self._append([c for c, _, _ in parts], self._gather(both), self._lengths[heads] + self._lengths[tails])

    def _append(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        if not chunks:
            return
        self._rows.update(zip(chunks, range(len(self._starts), len(self._starts) + len(chunks))))
        self._starts = np.concatenate([self._starts, len(self._flat) + np.cumsum(lengths) - lengths])
        self._lengths = np.concatenate([self._lengths, lengths])
        self._flat = np.concatenate([self._flat, ids])
        self._chars += sum(map(len, chunks))

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of rows, one after the other."""
        lengths = self._lengths[rows]
        upto = np.cumsum(lengths)
        return self._flat[np.repeat(self._starts[rows] - upto + lengths, lengths) + np.arange(int(upto[-1]) if len(upto) else 0)]

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """Of each text (null: empty), its ids as little-endian integers of type kind, and the end id behind them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        wide = pc.match_substring_regex(texts, WIDE)
        lower = pc.if_else(wide, texts, pc.utf8_lower(texts)) if pc.any(wide).as_py() else pc.utf8_lower(texts)
        split = pc.ascii_split_whitespace(lower)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn([w for w in words if w not in self._rows])
        row_of = np.fromiter(map(self._rows.__getitem__, words), np.int64, len(words))
        rows = row_of[coded.indices.to_numpy()]
        counts = split.value_lengths().to_numpy(zero_copy_only=False)
        ids, sizes = self._gather(rows), np.concatenate([[0], np.cumsum(self._lengths[rows])])
        offsets = sizes[np.concatenate([[0], np.cumsum(counts)])]
        if end is not None:
            ids = np.insert(ids, offsets[1:], end)
            offsets = offsets + np.arange(len(offsets))
        if len(self._rows) > KEPT_CHUNKS or self._chars > KEPT_CHARS:
            self._keep(words, row_of)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((offsets * self.kind.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])

    def _keep(self, words: list[str], rows: np.ndarray) -> None:
        """Forgets all chunks but the last ones, and those too if they are many or long."""
        ids, lengths = self._gather(rows), self._lengths[rows]
        self._forget()
        if len(words) <= KEPT_CHUNKS // 2 and sum(map(len, words)) <= KEPT_CHARS // 2:
            self._append(words, ids, lengths)


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


class FileWriter:
    def __init__(self, uri: str, bits: int) -> None:
        self.uri, self.bits = uri, bits
        self._out = blobstore.open_write(uri)
        self._out.write(HEADER.pack(MAGIC, bits, BLOCK))
        self._at, self.n_ids = HEADER.size, 0
        self._waiting: list[np.ndarray] = []
        self._held = 0
        self._offsets: list[int] = []
        self._docs: list[int] = []
        self._nulls = bytearray()
        self._ends: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append(doc_id or 0)
        self._nulls.append(doc_id is None)
        self.n_ids += len(ids)
        self._ends.append(self.n_ids)
        self._waiting.append(ids)
        self._held += len(ids)
        if self._held >= BLOCK:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self._waiting) if self._waiting else np.empty(0, "<u4")
        at = 0
        while len(ids) - at >= BLOCK or all_of_it and at < len(ids):
            raw = pack(ids[at : at + BLOCK], self.bits)
            self._offsets.append(self._at)
            self._out.write(raw)
            self._at += len(raw)
            at += BLOCK
        self._waiting = [ids[at:]]
        self._held = max(0, len(ids) - at)

    def close(self) -> int:
        """Ends the file; the count of its documents."""
        self._flush(True)
        index_at = self._at
        index = np.array(self._docs, "<i8").tobytes() + bytes(self._nulls) + np.array(self._ends, "<u8").tobytes()
        offsets = np.array(self._offsets, "<u8").tobytes()
        self._out.write(index + offsets)
        self._out.write(FOOTER.pack(len(self._docs), self.n_ids, len(self._offsets), index_at, index_at + len(index), MAGIC))
        self._out.close()
        return len(self._docs)


class FileReader:
    def __init__(self, uri: str) -> None:
        self._in = blobstore.open_read(uri)
        size = self._in.size()
        self.n_docs, self.n_ids, n_blocks, index_at, offsets_at, magic = FOOTER.unpack(self._in.read_at(FOOTER.size, size - FOOTER.size))
        head, self.bits, self.block = HEADER.unpack(self._in.read_at(HEADER.size, 0))
        if magic != MAGIC or head != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        raw = self._in.read_at(offsets_at - index_at, index_at)
        n = self.n_docs
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.nulls = np.frombuffer(raw, np.uint8, n, 8 * n)
        self.ends = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        self.offsets = np.append(np.frombuffer(self._in.read_at(8 * n_blocks, offsets_at), "<u8"), np.uint64(index_at)).astype(np.int64)

    def read_block(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        return unpack(self._in.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k])), n, self.bits)

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document, by random access."""
        lo, hi = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
        parts = [self.read_block(k) for k in range(lo // self.block, -(-hi // self.block))]
        base = lo // self.block * self.block
        return (np.concatenate(parts) if parts else np.empty(0, "<u4"))[lo - base : hi - base]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start in the file, ids) of all documents in order; each block is read once."""
        held, held_at, next_block = np.empty(0, "<u4"), 0, 0
        lo = 0
        for i in range(self.n_docs):
            hi = int(self.ends[i])
            if held_at + len(held) < hi:
                parts = [held[lo - held_at :]]
                while held_at + len(held) + sum(map(len, parts[1:])) < hi:
                    parts.append(self.read_block(next_block))
                    next_block += 1
                held, held_at = np.concatenate(parts), lo
            yield None if self.nulls[i] else int(self.doc_ids[i]), lo, held[lo - held_at : hi - held_at]
            lo = hi

    def close(self) -> None:
        self._in.close()


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about TOGETHER bytes in a column; a longer text is a slice of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOGETHER, side="right")))
        yield batch.slice(at, end - at)
        at = end


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str) -> DataFrame:
    """Encodes documents and writes their files; the manifest: (part, uri, n_docs, n_ids).

    Files hold ascending ranges of ids: part k lies before part k + 1. Only the
    packed ids are shuffled, once, straight to the task that writes them.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    at = F.coalesce("doc_id", F.lit(NULL_ID))
    bounds = range_bounds(narrow.select(at.alias("at")), "at", FILE_DOCS)
    bucket, parts = range_bucket(at, bounds, F.xxhash64("text")), len(bounds) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = own.encode(part.column("text"), end_id)
                yield pa.RecordBatch.from_arrays([part.column("part"), part.column("doc_id"), ids.cast(pa.binary())], names=["part", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, part = encoder(vocabulary), None, None

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "uri": out.uri, "n_docs": out.close(), "n_ids": out.n_ids}], schema=manifest)

        for batch in batches:
            for p, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if p != part:
                    if out is not None:
                        yield ended()
                    out, part = FileWriter(blobstore.attempt_name(folder, f"part-{p:05d}", ".tok"), own.bits), p
                out.add(doc_id, np.frombuffer(ids, own.kind))
        if out is not None:
            yield ended()

    manifest = pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    encoded = narrow.withColumn("part", bucket).mapInArrow(encode, "part int, doc_id long, ids binary")
    dealt = placed(encoded, parts, "part")
    ordered = dealt.sortWithinPartitions("part", at, F.xxhash64("ids"))
    return materialize(ordered.mapInArrow(write, "part int, uri string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Of each document in the manifest's files: (doc_id, start, n_tokens, ids_crc32)."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.select("part", "uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, base in zip(frame["uri"], frame["base"]):
                reader, rows = FileReader(uri), []
                for doc_id, start, ids in reader.documents():
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 4096:
                        yield as_frame(rows)
                        rows = []
                reader.close()
                yield as_frame(rows)

    def as_frame(rows: list[tuple]) -> pd.DataFrame:
        doc_id, start, n, crc = zip(*rows) if rows else ((), (), (), ())
        return pd.DataFrame({"doc_id": pd.array(doc_id, dtype="Int64"), "start": np.array(start, np.int64), "n_tokens": np.array(n, np.int64), "ids_crc32": np.array(crc, np.int64)})

    tasks = placed(files, max(1, manifest.count()), "part")
    return tasks.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes the token files of documents in the shared folder and returns what reading them gives."""
    return read_token_files(write_token_files(docs, vocabulary, end_id, new_path(docs.sparkSession, "tokens")))
