"""Versioned zone transition tables.

A table holds, for one IANA zone, every offset change between 1900 and 2100 as two arrays (UTC second of the change,
offsets around it) plus the abbreviations used. It is found by bisecting the public zone database through
``zoneinfo``, so nothing is transcribed, and it carries the database version it was built from. Tables built on the
driver travel with the job; every executor therefore converts with the same version, whatever its own host has.
"""

from __future__ import annotations

import functools
import hashlib
import zoneinfo
from datetime import datetime, timedelta, timezone
from pathlib import Path
from typing import NamedTuple

import numpy as np

FIRST, LAST = -2_208_988_800, 4_102_444_800  # 1900-01-01 and 2100-01-01
STEP = 7 * 86_400  # no zone has changed twice within a week in this span


class ZoneTable(NamedTuple):
    name: str
    version: str
    at: np.ndarray  # UTC seconds of each change
    offsets: np.ndarray  # len(at) + 1 offsets in seconds
    abbreviations: dict[str, int]  # latest offset used under each name


@functools.lru_cache(maxsize=1)
def database_version() -> str:
    """Version of the zone database that ``zoneinfo`` reads on this host; where none is stated, a hash of its files."""
    for root in zoneinfo.TZPATH:
        head = Path(root, "tzdata.zi")
        if head.exists():
            return head.open().readline().replace("# version", "").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        pass
    digest = hashlib.sha256()
    for name in sorted(zoneinfo.available_timezones()):
        for root in zoneinfo.TZPATH:
            if (file := Path(root, name)).is_file():
                digest.update(name.encode() + file.read_bytes())
                break
    return f"sha256:{digest.hexdigest()[:16]}"


def _state(zone: zoneinfo.ZoneInfo, second: int) -> tuple[int, str]:
    t = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second)).astimezone(zone)
    return int(t.utcoffset().total_seconds()), t.tzname() or ""


@functools.lru_cache(maxsize=1024)
def zone_table(name: str) -> ZoneTable | None:
    """Transition table of a zone; None for a name the database does not have."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
    at: list[int] = []
    low, state = FIRST, _state(zone, FIRST)
    offsets, names = [state[0]], {state[1]: state[0]}
    while low < LAST:
        high = min(low + STEP, LAST)
        after = _state(zone, high)
        if after != state:
            a, b = low, high
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if _state(zone, mid) == state else (a, mid)
            after = _state(zone, b)
            names[after[1]] = after[0]
            if after[0] != state[0]:
                at.append(b)
                offsets.append(after[0])
            state, low = after, b
        else:
            low = high
    return ZoneTable(name, database_version(), np.array(at, "int64"), np.array(offsets, "int64"), names)


def local_to_utc(local: np.ndarray, table: ZoneTable) -> np.ndarray:
    """UTC seconds for local wall-clock seconds.

    A change at ``t`` from offset a to b takes effect for wall clocks from ``t + max(a, b)``: before that, a clock
    that reads twice is its first reading and a clock that was skipped is carried forward by the gap.
    """
    before, after = table.offsets[:-1], table.offsets[1:]
    idx = np.searchsorted(table.at + np.maximum(before, after), local, side="right")
    return local - table.offsets[idx]
