"""Operator 8: WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about FRAME bytes. After
them come a skippable frame that maps record identifiers to (frame, offset within
the frame) and, last, the seek table of the Zstandard seekable format, so a single
record is read by decompressing the one frame that holds it.

Of records with equal payloads (of at least min_bytes bytes) the one with the
largest page id is written as response, the others as revisits of it; shorter ones
are all responses. Equal payloads meet by their SHA-1 in a join that adaptive
execution can split, not in one task.

Defined results: a null html is an empty payload; a null url gives a target made
from the identifier; a null id is the smallest and is a record named 'null'; rows
that share payload and the largest id are all responses; an empty table gives no
archives and no rows. Columns other than page_id, url and html are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from fathomix.llm import blobstore
from fathomix.llm.common import heavy_from, materialize, new_path

#: Uncompressed bytes after which a frame ends.
FRAME = 1 << 20
LEVEL = 3
#: Fixed values of the Zstandard seekable format, and a skippable frame of our own.
SKIPPABLE, SEEKABLE, INDEX = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
CRLF = b"\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    tail = identifier.removeprefix("<urn:page:").removesuffix(">")
    return None if tail == "null" else int(tail)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    target = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(fields).encode() + CRLF * 2 + block + CRLF * 2


def parse_record(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(named fields, block, where the next record begins)."""
    head_end = raw.index(CRLF * 2, at)
    lines = raw[at:head_end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    start = head_end + 4
    end = start + int(fields["Content-Length"])
    return fields, raw[start:end], end + 4


class BundleWriter:
    def __init__(self, uri: str) -> None:
        self.uri, self.n_records = uri, 0
        self._out = blobstore.open_write(uri)
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self._frame: list[bytes] = []
        self._size = 0
        self._frames: list[tuple[int, int]] = []
        self._index: list[tuple[int, int, int, int]] = []

    def add(self, page_id: int | None, record: bytes) -> None:
        self._index.append((page_id or 0, page_id is None, len(self._frames), self._size))
        self._frame.append(record)
        self._size += len(record)
        self.n_records += 1
        if self._size >= FRAME:
            self._end_frame()

    def _end_frame(self) -> None:
        if self._frame:
            raw = self._zstd.compress(b"".join(self._frame))
            self._out.write(raw)
            self._frames.append((len(raw), self._size))
            self._frame, self._size = [], 0

    def close(self) -> None:
        self._end_frame()
        columns = list(zip(*self._index)) or [(), (), (), ()]
        body = b"".join(np.array(c, kind).tobytes() for c, kind in zip(columns, ("<i8", "u1", "<u4", "<u4")))
        self._out.write(struct.pack("<II", INDEX, len(body)) + body)
        entries = [*self._frames, (len(body) + 8, 0)]
        table = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IBI", len(entries), 0, SEEKABLE)
        self._out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self._out.close()


class BundleReader:
    def __init__(self, uri: str) -> None:
        self._in = blobstore.open_read(uri)
        size = self._in.size()
        n, _, magic = struct.unpack("<IBI", self._in.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table: {uri}")
        entries = np.frombuffer(self._in.read_at(8 * n, size - 9 - 8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self._starts = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self._sizes = entries[:, 1]
        self.n_frames = n - 1
        self._zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        raw = self._in.read_at(int(self._starts[k + 1] - self._starts[k]), int(self._starts[k]))
        return self._zstd.decompress(raw, max_output_size=max(1, int(self._sizes[k])))

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for k in range(self.n_frames):
            raw, at = self.frame(k), 0
            while at < len(raw):
                fields, block, at = parse_record(raw, at)
                yield fields, block

    @cached_property
    def index(self) -> dict[int | None, tuple[int, int]]:
        """Record identifier to (frame, offset within it); read once."""
        start, end = int(self._starts[self.n_frames]), int(self._starts[self.n_frames + 1])
        body = self._in.read_at(end - start - 8, start + 8)
        n = len(body) // 17
        ids, nulls = np.frombuffer(body, "<i8", n), np.frombuffer(body, "u1", n, 8 * n)
        frames, offsets = np.frombuffer(body, "<u4", n, 9 * n), np.frombuffer(body, "<u4", n, 13 * n)
        return {None if null else int(i): (int(f), int(o)) for i, null, f, o in zip(ids, nulls, frames, offsets)}

    def fetch(self, page_id: int | None) -> tuple[dict[str, str], bytes]:
        k, offset = self.index[page_id]
        return parse_record(self.frame(k), offset)[:2]

    def close(self) -> None:
        self._in.close()


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes one bundle a task; the manifest: (uri, n_records)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    repeated = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1")
    )
    # A payload of very many pages is a heavy key: its pages are not dealt by its digest.
    least = heavy_from(pages.count())
    many = F.broadcast(repeated.where(F.col("n") > least).select("sha1", "kept"))  # less than HEAVY_KEYS rows
    rest = rows.join(many.select("sha1"), "sha1", "left_anti").join(repeated.where(F.col("n") <= least).select("sha1", "kept"), "sha1", "left")
    marked = rows.join(many, "sha1").unionByName(rest).select(
        "page_id",
        "url",
        "payload",
        F.col("kept").alias("kept"),
        (F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))).alias("revisit"),
    )
    # Ids pass as strings, as pandas would make doubles of long columns with nulls.
    shipped = marked.withColumns({c: F.col(c).cast("string") for c in ("page_id", "kept")})

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for frame in frames:
            for page_id, url, payload, kept, revisit in zip(*(frame[c] for c in frame.columns)):
                if out is None:
                    out = BundleWriter(blobstore.attempt_name(folder, "bundle", ".warc.zst"))
                page_id = None if page_id is None else int(page_id)
                out.add(page_id, build_record(page_id, url, payload, int(kept) if revisit else None, revisit))
        if out is not None:
            out.close()
            yield pd.DataFrame({"uri": [out.uri], "n_records": [out.n_records]})

    return materialize(shipped.mapInPandas(write, "uri string, n_records long"), "warc-manifest")


def read_bundles(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["uri"]:
                reader, rows = BundleReader(uri), []
                for fields, block in reader.records():
                    head, _, payload = block.partition(CRLF * 2)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(head.rpartition(b"Content-Length: ")[2])
                    kind = fields["WARC-Type"]
                    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {uri}")
                    rows.append((page_of(fields["WARC-Record-ID"]), length, digest, kind, page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None))
                    if len(rows) == 2048:
                        yield as_frame(rows)
                        rows = []
                reader.close()
                yield as_frame(rows)

    def as_frame(rows: list[tuple]) -> pd.DataFrame:
        page, length, digest, kind, refers = zip(*rows) if rows else ((), (), (), (), ())
        return pd.DataFrame({"page_id": pd.array(page, dtype="Int64"), "payload_bytes": np.array(length, np.int64), "payload_digest": list(digest), "record_type": list(kind), "refers_to": pd.array(refers, dtype="Int64")})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.repartition(max(1, manifest.count())).mapInPandas(read, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages as bundles in the shared folder and returns what reading them gives."""
    return read_bundles(write_bundles(pages, new_path(pages.sparkSession, "warc"), min_bytes))
