"""Transition tables of time zones, from their oldest transition on and without end.

The tables come from the zone files of one edition, which the driver reads and sends to the executors, so that all tasks convert by the
same data.  Beyond its last transition a zone follows the closing rule of its file; the rule is written out for the 400 years
after which the calendar repeats, and later times are moved back by whole such periods.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from datetime import date
from functools import lru_cache
from importlib import resources
from pathlib import Path
from zoneinfo import TZPATH, available_timezones

import numpy as np

_LOWEST = np.iinfo(np.int64).min
PERIOD = 146_097 * 86_400  # 400 years
_RULE = re.compile(r"(?P<std><[^>]+>|[A-Za-z]{3,})(?P<so>[+-]?[\d:]+)(?:(?P<dst><[^>]+>|[A-Za-z]{3,})(?P<do>[+-]?[\d:]+)?,(?P<start>[^,]+),(?P<end>[^,]+))?$")


def _file(name: str) -> bytes | None:
    for folder in TZPATH:
        path = Path(folder, *name.split("/"))
        if path.is_file():
            return path.read_bytes()
    try:
        return resources.files("tzdata.zoneinfo").joinpath(*name.split("/")).read_bytes()
    except (ImportError, OSError):
        return None


@lru_cache(maxsize=1)
def edition() -> tuple[str, bytes]:
    """(version of the zone data, the files of all zones, packed)."""
    files = {name: data for name in sorted(available_timezones()) if (data := _file(name)) and data[:4] == b"TZif"}
    body = b"".join(struct.pack("<HI", len(n.encode()), len(d)) + n.encode() + d for n, d in files.items())
    version = ""
    for folder in TZPATH:
        for name in ("+VERSION", "tzdata.zi"):
            path = Path(folder, name)
            if not version and path.is_file():
                with open(path) as f:
                    version = f.readline().replace("# version", "").strip()
    if not version:
        try:
            import tzdata

            version = tzdata.IANA_VERSION
        except ImportError:
            pass
    return f"{version or 'unknown'}-{hashlib.sha256(body).hexdigest()[:8]}", zlib.compress(body)


def _seconds(text: str) -> int:
    sign = -1 if text.startswith("-") else 1
    parts = [int(x) for x in text.lstrip("+-").split(":")] + [0, 0]
    return sign * (parts[0] * 3600 + parts[1] * 60 + parts[2])


def _change(rule: str, year: int) -> int:
    """Wall seconds of a closing rule's change in a year."""
    day, _, at = rule.partition("/")
    first = date(year, 1, 1).toordinal()
    if day[0] == "M":
        month, week, weekday = (int(x) for x in day[1:].split("."))
        start = date(year, month, 1)
        ordinal = start.toordinal() + (weekday - start.isoweekday()) % 7 + 7 * (week - 1)
        following = (date(year + 1, 1, 1) if month == 12 else date(year, month + 1, 1)).toordinal()
        while ordinal >= following:
            ordinal -= 7
    elif day[0] == "J":  # February 29 is never counted
        n = int(day[1:])
        leap = date(year, 12, 31).timetuple().tm_yday == 366
        ordinal = first + n - 1 + (leap and n > 59)
    else:
        ordinal = first + int(day)
    return (ordinal - date(1970, 1, 1).toordinal()) * 86_400 + _seconds(at or "2")


class Table:
    """walls: wall-clock seconds from which each offset holds; last: from there the rule repeats every PERIOD, if there is one."""

    def __init__(self, data: bytes):
        head = struct.unpack(">6l", data[20:44])

        def size(counts, wide: int) -> int:
            return counts[3] * (wide + 1) + counts[4] * 6 + counts[5] + counts[2] * (wide + 4) + counts[1] + counts[0]

        at, wide = 44, 4
        if data[4:5] >= b"2":
            at, wide = 44 + size(head, 4) + 44, 8
            head = struct.unpack(">6l", data[at - 24 : at])
        n, kinds = head[3], head[4]
        times = np.frombuffer(data, f">i{wide}", n, at).astype(np.int64)
        index = np.frombuffer(data, np.uint8, n, at + n * wide)
        base = at + n * (wide + 1)
        offsets = np.array([struct.unpack(">l", data[base + 6 * k : base + 6 * k + 4])[0] for k in range(kinds)], np.int64)
        footer = data[at + size(head, wide) :].strip(b"\n").decode() if wide == 8 else ""
        instants, after = times.tolist(), offsets[index].tolist()
        self.last = None
        if (m := _RULE.match(footer)) and m["dst"]:
            standard = -_seconds(m["so"])
            summer = -_seconds(m["do"]) if m["do"] else standard + 3600
            year = 1970 if not instants else int(np.datetime64(instants[-1], "s").astype("datetime64[Y]").astype(int)) + 1970
            made = []
            for y in range(year, year + 403):
                made += [(_change(m["start"], y) - standard, summer), (_change(m["end"], y) - summer, standard)]
            latest = instants[-1] if instants else _LOWEST
            made = sorted(x for x in made if x[0] > latest)
            instants += [t for t, _ in made]
            after += [o for _, o in made]
            self.last = made[0][0] + PERIOD + 86_400  # a whole period has been written out from the first change on
        elif m and instants:
            instants, after = instants + [instants[-1] + 1], after + [-_seconds(m["so"])]
        elif m:
            instants, after = [0], [-_seconds(m["so"])]
        before = [int(offsets[0]), *after[:-1]] if after else []
        walls = [_LOWEST] + [t + max(a, b) for t, a, b in zip(instants, before, after)]
        self.walls = np.maximum.accumulate(np.array(walls, np.int64))
        self.offsets = np.array([int(offsets[0]) if kinds else 0, *after], np.int64)

    def to_utc(self, wall: np.ndarray) -> np.ndarray:
        """UTC seconds: a wall time that occurs twice is its earlier instant, a skipped one moves on by the skipped span."""
        back = 0 if self.last is None else np.maximum(0, -(-(wall - self.last) // PERIOD)) * PERIOD
        return wall - self.offsets[np.searchsorted(self.walls, wall - back, "right") - 1]


class Zones:
    """Tables of one edition, made when they are asked for."""

    def __init__(self, packed: bytes):
        body, at = zlib.decompress(packed), 0
        self.files: dict[str, bytes] = {}
        self.tables: dict[str, Table] = {}
        while at < len(body):
            a, b = struct.unpack("<HI", body[at : at + 6])
            self.files[body[at + 6 : at + 6 + a].decode()] = body[at + 6 + a : at + 6 + a + b]
            at += 6 + a + b

    def get(self, name: str) -> Table | None:
        if name not in self.tables and name in self.files:
            self.tables[name] = Table(self.files[name])
        return self.tables.get(name)


@lru_cache(maxsize=1)
def local() -> Zones:
    return Zones(edition()[1])
