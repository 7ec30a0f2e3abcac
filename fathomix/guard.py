"""Keeps a process to hosts of its own machine while it searches or indexes."""

from __future__ import annotations

import ipaddress
import sys
import threading
from collections.abc import Iterable, Iterator
from contextlib import contextmanager


class OutboundBlocked(PermissionError):
    pass


def is_local(host: str, allowed: Iterable[str] = ()) -> bool:
    """Whether a host is one of those allowed or a loopback address."""
    bare = host.strip("[]").split("%")[0]
    if bare in allowed or bare == "localhost":
        return True
    try:
        return ipaddress.ip_address(bare).is_loopback
    except ValueError:
        return False


class _Watch:
    """One audit hook a process; it looks at connections only while someone asks for it in the same thread."""

    def __init__(self) -> None:
        self.installed = False
        self.allowed = threading.local()

    def __call__(self, event: str, args: tuple) -> None:
        wanted = getattr(self.allowed, "hosts", None)
        if wanted is None or event not in ("socket.connect", "socket.getaddrinfo"):
            return
        target = args[1] if event == "socket.connect" else args[:1]
        host = target[0] if isinstance(target, tuple) and target else None
        if isinstance(host, str) and not is_local(host, wanted):
            raise OutboundBlocked(f"no connection to {host}: only hosts of this machine are allowed")


_WATCH = _Watch()


@contextmanager
def local_only(allowed: Iterable[str] = (), active: bool = True) -> Iterator[None]:
    """Within the block, connections of this thread to other machines raise OutboundBlocked. Sockets without a host pass."""
    if not active:
        yield
        return
    if not _WATCH.installed:
        sys.addaudithook(_WATCH)
        _WATCH.installed = True
    outer = getattr(_WATCH.allowed, "hosts", None)
    _WATCH.allowed.hosts = tuple(allowed)
    try:
        yield
    finally:
        _WATCH.allowed.hosts = outer
