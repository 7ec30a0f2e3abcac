"""The index folder: versions of tables, and one manifest that names the current ones.

A run writes all its tables under new names and then moves one small file into place,
so a reader sees the tables of one run, never new files beside old chunks. What the
last manifest but one named is deleted then: who opened the index before the last run
can still read it through.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

import pyarrow.fs as pafs

MANIFEST = "manifest.json"


class Store:
    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self.fs, self.path = pafs.FileSystem.from_uri(self.folder if ":/" in self.folder else f"file://{self.folder}")

    def manifest(self) -> dict[str, Any]:
        """tables: name to its folders; before: folders of the run before; state: of the last run."""
        try:
            with self.fs.open_input_stream(f"{self.path}/{MANIFEST}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return {"tables": {}, "before": [], "state": {}}

    def new_name(self, table: str) -> str:
        return f"{table}-{uuid.uuid4().hex}"

    def uri(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def commit(self, tables: dict[str, list[str]], state: dict[str, Any]) -> None:
        old = self.manifest()
        current = {x for names in tables.values() for x in names}
        before = sorted({x for names in old["tables"].values() for x in names} - current)
        self._put({"tables": tables, "before": before, "state": state})
        for name in set(old["before"]) - current - set(before):
            self.delete(name)

    def save_state(self, state: dict[str, Any]) -> None:
        self._put({**self.manifest(), "state": state})

    def _put(self, manifest: dict[str, Any]) -> None:
        self.fs.create_dir(self.path, recursive=True)
        fresh = f"{self.path}/{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(fresh) as f:
            f.write(json.dumps(manifest).encode())
        self.fs.move(fresh, f"{self.path}/{MANIFEST}")

    def delete(self, name: str) -> None:
        try:
            self.fs.delete_dir(f"{self.path}/{name}")
        except FileNotFoundError:
            pass

    def size_of(self, names: list[str]) -> int:
        """Bytes in some folders."""
        every = (self.fs.get_file_info(pafs.FileSelector(f"{self.path}/{name}", recursive=True, allow_not_found=True)) for name in names)
        return sum(f.size or 0 for infos in every for f in infos if f.is_file)

    def leftovers(self) -> list[str]:
        """Folders that no manifest names: of runs that failed, or superseded."""
        kept = {x for names in self.manifest()["tables"].values() for x in names}
        infos = self.fs.get_file_info(pafs.FileSelector(self.path, allow_not_found=True))
        return sorted(i.base_name for i in infos if i.type == pafs.FileType.Directory and i.base_name not in kept)

    def wipe(self) -> None:
        """Removes the index, data and all."""
        infos = self.fs.get_file_info(pafs.FileSelector(self.path, allow_not_found=True))
        for i in infos:
            self.fs.delete_dir(i.path) if i.type == pafs.FileType.Directory else self.fs.delete_file(i.path)
