"""Column functions on paths: names, types, roots and globs."""

from __future__ import annotations

import datetime
import fnmatch
import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Suffixes of each type, tried in this order.
SUFFIXES = {
    "text": ".txt .md .rst .log .csv .tsv .json .yaml .yml .py .js .ts .go .java .c .cc .cpp .h .hpp .rs .rb .php .html .css .sh .zsh .toml .ini",
    "pdf": ".pdf",
    "image": ".jpg .jpeg .png .webp .bmp .gif .tif .tiff",
    "audio": ".wav .mp3 .m4a .aac .flac .ogg .opus",
    "video": ".mp4 .mov .mkv .avi .webm .m4v",
    "archive": ".zip .tar .tgz .7z",
}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_type(path: Column) -> Column:
    """The type by lower-cased suffix, null for an unknown one; a leading dot makes no suffix."""
    name = F.lower(basename(path))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    out = F.lit(None).cast("string")
    for kind, suffixes in reversed(SUFFIXES.items()):
        hit = suffix.isin(suffixes.split())
        out = F.when(hit | name.endswith(".tar.gz") if kind == "archive" else hit, F.lit(kind)).otherwise(out)
    return out


def below_any(path: Column, roots: Iterable[str]) -> Column:
    """Whether path is one of roots or lies below one, by whole components; no roots: always."""
    out = None
    for root in roots:
        root = os.path.expanduser(root).rstrip("/")
        hit = (path == root) | path.startswith(root + "/")
        out = hit if out is None else out | hit
    return F.lit(True) if out is None else out


def _char(c: str) -> str:
    return rf"\x{{{ord(c):X}}}"


def _char_class(body: str, negated: bool) -> str:
    parts, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high, i = body[i], body[i + 2], i + 3
            if low <= high:
                parts.append(f"{_char(low)}-{_char(high)}")
        else:
            parts.append(_char(body[i]))
            i += 1
    if not parts:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def glob_pattern(glob: str) -> str:
    """A Java pattern for a shell glob in which * crosses slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            start = i + (glob[i : i + 1] == "!")
            end = glob.find("]", start + 1)
            if end < 0:
                out.append(_char("["))
            else:
                out.append(_char_class(glob[start:end], start > i))
                i = end + 1
        else:
            out.append(c if c.isalnum() and c.isascii() else _char(c))
    # A star at an end needs no walk to that end.
    head, tail = "" if out[:1] == [".*"] else r"\A", "" if out[-1:] == [".*"] else r"\z"
    return f"(?s){head}(?:{''.join(out[head == '' : len(out) - (tail == '')])}){tail}"


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    """Whether a glob matches the whole path; one that ends in /** also matches the folder itself."""
    every = with_folders(globs)
    return path.rlike("|".join(f"(?:{glob_pattern(glob)})" for glob in every)) if every else F.lit(False)


def with_folders(globs: Iterable[str]) -> list[str]:
    """The globs, and the folder itself of each that ends in /**."""
    return list(dict.fromkeys(g for glob in globs for g in ([glob, glob[:-3]] if glob.endswith("/**") and len(glob) > 3 else [glob])))


def glob_matcher(globs: Iterable[str]) -> re.Pattern | None:
    """matches_any() of one path, as a pattern to match; None without globs."""
    every = with_folders(globs)
    return re.compile("|".join(map(fnmatch.translate, every))) if every else None


def allowed(path: Column, allow_roots: Iterable[str], ignore: Iterable[str]) -> Column:
    return below_any(path, allow_roots) & ~matches_any(path, ignore)


def ancestors(path: Column, root: str) -> Column:
    """The folders between root and path, outermost first."""
    depth = len([x for x in root.split("/") if x])
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(
        F.size(parts) - 1 > depth,
        F.transform(F.sequence(F.lit(depth + 1), F.greatest(F.size(parts) - 1, F.lit(depth + 1))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"))),
    ).otherwise(F.array().cast("array<string>"))


def pruned(path: Column, root: str, ignore: Iterable[str]) -> Column:
    """Whether a folder below root that holds the path is ignored, so that a walk never gets there."""
    return F.exists(ancestors(path, root), lambda folder: matches_any(folder, ignore))


def safe_member(inner: Column) -> Column:
    """Whether an archive member stays below the folder it is extracted to.

    Leading slashes go before backslashes become slashes, so a path that starts with
    backslashes is absolute and unsafe.
    """
    stripped = F.translate(F.regexp_replace(inner, "^/+", ""), "\\", "/")
    parts = F.split(stripped, "/")
    depth = F.aggregate(
        parts,
        F.lit(0),
        lambda d, p: F.when(d < 0, d).when((p == "") | (p == "."), d).when(p == "..", d - 1).otherwise(d + 1),
    )
    plain = ~inner.contains("..") & ~inner.contains("\\")  # nothing that could lead upwards: most names
    return F.when(plain, F.lit(True)).otherwise((depth >= 0) & ~stripped.startswith("/"))


def type_of(path: str) -> str | None:
    """file_type() of one path."""
    name = path.rsplit("/", 1)[-1].lower()
    if name.endswith(".tar.gz") and len(name) > len(".gz"):
        return "archive"
    stem, dot, ending = name.rpartition(".")
    return next((kind for kind, suffixes in SUFFIXES.items() if stem and f"{dot}{ending}" in suffixes.split()), None)


def is_safe_member(inner: str) -> bool:
    """safe_member() of one name."""
    parts, depth = inner.lstrip("/").replace("\\", "/").split("/"), 0
    for p in parts:
        depth += {"": 0, ".": 0, "..": -1}.get(p, 1)
        if depth < 0:
            return False
    return bool(parts[0]) or len(parts) == 1


def parse_since(text: str | None) -> int | None:
    """Nanoseconds of a date's start in UTC; None for no filter. Malformed text is an error."""
    if text is None or text.strip().lower() in ("", "none", "null", "yyyy-mm-dd"):
        return None
    day = datetime.datetime.strptime(text.strip(), "%Y-%m-%d").replace(tzinfo=datetime.timezone.utc)
    return min(int(day.timestamp()) * 1_000_000_000, 2**63 - 1)
