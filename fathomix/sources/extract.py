"""Content of files: each changed file is read once, in the task that takes its parts out.

Bytes never leave that task; what comes out are rows of text, images, times, members of
archives and errors. A file that fails gives one row with its error and ends no task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from fathomix.functions.paths import is_safe_member, type_of
from fathomix.operators.archives import SEPARATOR, members
from fathomix.sources import media
from fathomix.sources.files import is_remote

#: part: file (one a real or virtual file), text, page, segment, frame, entry (a member of an archive).
EXTRACTED = (
    "path string, real_path string, type string, size_bytes long, mtime_ns long, part string, no long, text string, image binary, "
    "start_ms long, end_ms long, width int, height int, error string, skipped string"
)
NAMES = [c.split()[0] for c in EXTRACTED.split(", ")]


@dataclass(frozen=True)
class Readers:
    """What takes a file's parts out of its bytes; transcriber is made once a worker, or None."""

    pdf: Callable[[bytes], list[str]] = media.read_pdf
    image: Callable[[bytes], tuple[int, int, bytes]] = media.read_image
    frames: Callable[[bytes, str, float, int], list[tuple[int, bytes]]] = media.read_frames
    sound: Callable[[bytes, str], bytes | None] = media.read_sound
    transcriber: Callable[[], Callable[[bytes], list[tuple[float, float, str]]]] | None = None


@dataclass(frozen=True)
class Limits:
    max_text_bytes: int = 20 * 1024 * 1024
    archive_bytes: int = 1 << 30
    extract_small: bool = True
    frame_every_s: float = 2.0
    max_frames: int = 2000
    #: What hides members of archives, by their whole path or the path within.
    hidden: re.Pattern | None = None


def _segments(told: list[tuple[float, float, str]]) -> Iterator[dict]:
    for start, end, text in told:
        if text := text.strip():
            yield {"part": "segment", "text": text, "start_ms": int(start * 1000), "end_ms": int(end * 1000)}


def _parts(kind: str, path: str, raw: bytes, readers: Readers, limits: Limits, transcribe) -> Iterator[dict]:
    suffix = os.path.splitext(path)[1]
    if kind == "text":
        yield {"part": "text", "text": raw[: limits.max_text_bytes].decode("utf-8", "ignore")}
    elif kind == "pdf":
        for page in readers.pdf(raw):
            yield {"part": "page", "text": page}
    elif kind == "image":
        width, height, pixels = readers.image(raw)
        yield {"part": "frame", "image": pixels, "width": width, "height": height}
    elif kind == "audio" and transcribe is not None:
        yield from _segments(transcribe(raw))
    elif kind == "video":
        for at_ms, image in readers.frames(raw, suffix, limits.frame_every_s, limits.max_frames):
            try:
                width, height, pixels = readers.image(image)
            except Exception:  # noqa: BLE001  a frame that cannot be decoded is left out
                continue
            yield {"part": "frame", "image": pixels, "width": width, "height": height, "start_ms": at_ms}
        if transcribe is not None and (sound := readers.sound(raw, suffix)) is not None:
            yield from _segments(transcribe(sound))


def _file(base: dict, raw: Callable[[], bytes], readers: Readers, limits: Limits, transcribe) -> Iterator[dict]:
    """The rows of one file: its parts, then the file itself with its outcome."""
    kind, outcome, counts = base["type"], {}, {}
    try:
        if kind == "audio" and transcribe is None:
            outcome = {"skipped": "no transcriber"}
        elif kind == "archive":
            yield from _archive(base, raw(), readers, limits, transcribe)
        else:
            for part in _parts(kind, base["path"], raw(), readers, limits, transcribe):
                no = counts[part["part"]] = counts.get(part["part"], -1) + 1
                yield {**base, **part, "no": no}
    except Exception as e:  # noqa: BLE001  the error is the file's value
        outcome = {"error": f"{type(e).__name__}: {e}"}
    yield {**base, "part": "file", **outcome}


def _archive(base: dict, content: bytes, readers: Readers, limits: Limits, transcribe) -> Iterator[dict]:
    small = limits.extract_small and base["size_bytes"] <= limits.archive_bytes
    inside = []
    for inner, size, mtime, body in members(base["path"], content, small):
        if small and not is_safe_member(inner):
            raise ValueError(f"an archive member leaves its folder: {inner}")
        yield {**base, "part": "entry", "text": inner, "size_bytes": size, "mtime_ns": mtime}
        path = f"{base['path']}{SEPARATOR}{inner}"
        kind = type_of(inner)
        # An archive in an archive is listed, not opened.
        if small and kind not in (None, "archive") and not (limits.hidden and (limits.hidden.match(path) or limits.hidden.match(f"/{inner}"))):
            inside.append(({**base, "path": path, "real_path": base["path"], "type": kind, "size_bytes": size, "mtime_ns": mtime}, body))
    for own, body in inside:
        yield from _file(own, lambda body=body: body, readers, limits, transcribe)


def extracted(files: DataFrame, readers: Readers, limits: Limits, task_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """EXTRACTED rows of files (path, type, size_bytes, mtime_ns), which all executors can open by path or URI.

    Files are dealt to tasks by a hash, so many that a task reads about task_bytes.
    """
    total = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(100_000, total[1], -(-total[0] // task_bytes) + total[1] // 10_000))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transcribe = readers.transcriber() if readers.transcriber else None
        held: list[dict] = []
        size = 0
        for frame in frames:
            for path, kind, n_bytes, mtime in frame.itertuples(index=False):
                base = {"path": path, "real_path": path, "type": kind, "size_bytes": int(n_bytes), "mtime_ns": int(mtime)}
                for row in _file(base, lambda path=path: _bytes(path), readers, limits, transcribe):
                    held.append(row)
                    size += len(row.get("text") or "") + len(row.get("image") or b"") + 200
                    if size > 8_000_000:
                        yield as_frame(held)
                        held, size = [], 0
        yield as_frame(held)

    def as_frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=NAMES, dtype=object)
        return out.astype({c: "Int64" for c in ("size_bytes", "mtime_ns", "no", "start_ms", "end_ms")} | {c: "Int32" for c in ("width", "height")})

    return files.select("path", "type", "size_bytes", "mtime_ns").repartition(tasks, "path").mapInPandas(run, EXTRACTED)


def _bytes(path: str) -> bytes:
    if is_remote(path):
        store, inside = pafs.FileSystem.from_uri(path)
        with store.open_input_file(inside) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()
