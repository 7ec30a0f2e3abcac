"""A bounded two-generation cache: what is used stays, what is not goes."""

from __future__ import annotations

from collections.abc import Callable


class GenerationCache(dict):
    """Maps a key to compute(key). Holds at most 2 * half entries.

    Lookup through ``cache[key]``: a hit costs one dict access; a miss looks in
    the older generation before it computes.
    """

    def __init__(self, compute: Callable, half: int) -> None:
        super().__init__()
        self._compute, self._half, self.old = compute, half, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self._compute(key)
        if len(self) >= self._half:
            self._turn()
        self[key] = value
        return value

    def put_all(self, items: dict) -> None:
        """Puts items that are computed already; of more than half only the last."""
        if len(self) + len(items) > self._half:
            self._turn()
        self.update(items if len(items) <= self._half else dict(list(items.items())[-self._half :]))

    def _turn(self) -> None:
        self.old = dict(self)
        self.clear()
