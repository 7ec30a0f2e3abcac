"""Load of this machine, and a gate that holds work while the load is high."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from fathomix.config import LoadShedding


@dataclass(frozen=True)
class Sample:
    cpu_percent: float
    load1: float | None
    mem_available_gb: float
    cores: int


class HostSampler:
    """Samples of this host from /proc, or from psutil where that is there and /proc is not."""

    def __init__(self) -> None:
        self._last: tuple[int, int] | None = None

    def _cpu_percent(self) -> float:
        """Busy time since the last sample, in percent; 0 at first."""
        try:
            with open("/proc/stat") as f:
                ticks = [int(x) for x in f.readline().split()[1:9]]
        except OSError:
            import psutil

            return float(psutil.cpu_percent(interval=None))
        now = (sum(ticks), ticks[3] + ticks[4])
        last, self._last = self._last, now
        passed = now[0] - last[0] if last else 0
        return 100.0 * (1 - (now[1] - last[1]) / passed) if passed > 0 else 0.0

    @staticmethod
    def _available_gb() -> float:
        try:
            with open("/proc/meminfo") as f:
                told = dict(line.split(":", 1) for line in f)
            return int(told["MemAvailable"].split()[0]) / 2**20
        except (OSError, KeyError):
            import psutil

            return psutil.virtual_memory().available / 2**30

    def __call__(self) -> Sample:
        try:
            load1 = os.getloadavg()[0]
        except OSError:
            load1 = None
        return Sample(self._cpu_percent(), load1, self._available_gb(), os.cpu_count() or 1)


def high_reason(s: Sample, limits: LoadShedding) -> str | None:
    """Why a sample is high: the first of memory, CPU, load."""
    if s.mem_available_gb < limits.mem_available_min_gb:
        return f"mem_available_gb<{limits.mem_available_min_gb:.2f}"
    if s.cpu_percent > limits.cpu_pause_percent:
        return f"cpu>{limits.cpu_pause_percent:.0f}%"
    if s.load1 is not None and s.load1 > s.cores * limits.load_factor:
        return f"load1>{s.cores * limits.load_factor:.2f}"
    return None


@dataclass
class Gate:
    """Closes once the load is high for pause_after_s without a break, opens once it is low for resume_after_s."""

    limits: LoadShedding
    sampler: Callable[[], Sample] = field(default_factory=HostSampler)
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    every_s: float = 1.0
    paused: bool = False
    reason: str | None = None
    paused_at: float | None = None
    _high: bool | None = None
    _since: float = 0.0

    def look(self) -> bool:
        """Takes a sample; whether work is to wait."""
        try:
            why = high_reason(self.sampler(), self.limits)
        except Exception:  # noqa: BLE001  a load that cannot be told holds nothing up
            why = None
        now, high = self.clock(), why is not None
        if high != self._high:
            self._high, self._since = high, now
        held = now - self._since
        if high and held >= self.limits.pause_after_s:
            self.paused_at = self.paused_at if self.paused else now
            self.paused, self.reason = True, why
        elif not high and held >= self.limits.resume_after_s:
            self.paused, self.reason, self.paused_at = False, None, None
        return self.paused

    def wait(self, told: Callable[[Gate], None] = lambda gate: None) -> float:
        """Returns once the gate is open; the seconds waited. told is called after each sample that keeps it closed."""
        began = self.clock()
        while self.look():
            told(self)
            self.sleep(self.every_s)
        return self.clock() - began

    @property
    def paused_for_s(self) -> float | None:
        return None if self.paused_at is None else self.clock() - self.paused_at
