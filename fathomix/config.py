"""Engine settings with their defaults, read from and written to a YAML file; unknown keys are ignored with a warning."""

from __future__ import annotations

import csv
import typing
import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

from fathomix import plainyaml

# What is never indexed.
IGNORED = ("**/.ssh/**", "**/.gnupg/**", "**/Library/Keychains/**", "**/.env", "**/*.pem", "**/*.key", "**/*id_rsa*", "/System/**", "/Library/**")


@dataclass
class Indexing:
    chunk_chars: int = 2000
    chunk_overlap_chars: int = 200
    max_text_bytes: int = 20 * 1024 * 1024
    snippet_chars: int = 512
    inner_paths: int = 5000
    rescan_interval_s: float = 30.0
    hash_dim: int = 384
    #: Changed files that are indexed together; then the run commits, looks at the load, and goes on.
    batch_files: int = 1_000_000
    #: Bytes of files that one task reads, about.
    task_bytes: int = 64 * 1024 * 1024


@dataclass
class Archives:
    size_threshold: int = 1 << 30
    extract_small: bool = True


@dataclass
class LoadShedding:
    cpu_pause_percent: float = 70.0
    mem_available_min_gb: float = 2.0
    load_factor: float = 0.8
    pause_after_s: float = 10.0
    resume_after_s: float = 30.0


@dataclass
class Video:
    frame_every_seconds: float = 2.0
    max_frames: int = 2000


@dataclass
class Search:
    vector_k: int = 50
    fts_k: int = 50
    w_vec: float = 0.7
    w_fts: float = 0.3
    top: int = 20
    rerank_items: int = 30
    #: How vectors are searched: exact, or lsh, which finds about the nearest.
    nearest: str = "exact"


@dataclass
class Models:
    #: A chain of embedders, tried in this order: names in fathomix.models, or module:factory.
    embedders: list[str] = field(default_factory=lambda: ["hash"])
    #: The same for text, where it is not to be embedded like images; empty: as above.
    text_embedders: list[str] = field(default_factory=list)
    #: A transcriber in fathomix.models, or module:factory; empty: none.
    transcriber: str = ""


@dataclass
class LanguageModel:
    enabled: bool = False
    base_url: str = "http://127.0.0.1:11434"
    model: str = ""
    timeout_s: float = 30.0
    parse_queries: bool = True
    rerank: bool = True


@dataclass
class Security:
    local_only: bool = True
    allowed_hosts: list[str] = field(default_factory=lambda: ["127.0.0.1", "localhost", "::1"])


@dataclass
class Config:
    roots: list[str] = field(default_factory=list)
    allow_roots: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=lambda: list(IGNORED))
    indexing: Indexing = field(default_factory=Indexing)
    archives: Archives = field(default_factory=Archives)
    load: LoadShedding = field(default_factory=LoadShedding)
    video: Video = field(default_factory=Video)
    search: Search = field(default_factory=Search)
    models: Models = field(default_factory=Models)
    language_model: LanguageModel = field(default_factory=LanguageModel)
    security: Security = field(default_factory=Security)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def save(self, path: str) -> None:
        Path(path).write_text(plainyaml.dump(self.to_dict()))

    @classmethod
    def read(cls, path: str) -> Config:
        return merge(cls(), plainyaml.load(Path(path).read_text()))


class SettingError(ValueError):
    """A setting that is not there, or a text that is no value for it."""


def merge(target: Any, values: dict[str, Any]) -> Any:
    known = {f.name for f in fields(target)}
    for key, value in values.items():
        if key not in known:
            warnings.warn(f"unknown setting ignored: {key}", stacklevel=2)
        elif is_dataclass(getattr(target, key)):
            merge(getattr(target, key), value or {})
        else:
            setattr(target, key, value)
    return target


def _switch(text: str) -> bool:
    return {"on": True, "off": False, "yes": True, "no": False, "true": True, "false": False}[text.casefold()]


def _items(text: str) -> list[str]:
    """One line of comma-separated values; quotes keep a comma."""
    return [x for x in next(csv.reader([text], skipinitialspace=True), []) if x]


#: How the text of a setting becomes a value, by the type it is declared with.
READERS: dict[Any, Callable[[str], Any]] = {bool: _switch, int: int, float: float, str: str, list[str]: _items}


def change(config: Config, key: str, text: str) -> None:
    """Sets section.name to what the text says in the declared type of that setting."""
    section, _, name = key.rpartition(".")
    owner = getattr(config, section, None) if section else config
    declared = typing.get_type_hints(type(owner)).get(name) if is_dataclass(owner) else None
    if declared not in READERS:
        raise SettingError(f"no such setting: {key}")
    try:
        setattr(owner, name, READERS[declared](text.strip()))
    except (KeyError, ValueError):
        raise SettingError(f"{key}: {text!r} is no {getattr(declared, '__name__', declared)}") from None
