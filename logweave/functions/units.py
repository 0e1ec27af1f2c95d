"""Numbers with units as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units, their kinds and factors.  Kinds: 1 bytes, 2 bits per second, 3 milliseconds.
UNITS: dict[str, tuple[int, float]] = {
    "b": (1, 1.0), "kb": (1, 1024.0), "mb": (1, 1024.0**2), "gb": (1, 1024.0**3), "tb": (1, 1024.0**4),
    "bps": (2, 1.0), "kbps": (2, 1e3), "mbps": (2, 1e6), "gbps": (2, 1e9),
    "ms": (3, 1.0), "s": (3, 1e3), "sec": (3, 1e3), "seg": (3, 1e3), "m": (3, 6e4), "min": (3, 6e4), "h": (3, 3.6e6), "d": (3, 8.64e7),
}
NUMBER, BYTES, BITS, DURATION = range(4)
_SHAPE = r"^([+-]?(?:[0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?)\s*([a-z]*)$"


def _parts(c: Column) -> tuple[Column, Column]:
    text = F.lower(F.trim(c))
    return F.regexp_extract(text, _SHAPE, 1), F.regexp_extract(text, _SHAPE, 2)


def unit_kind(c: Column) -> Column:
    """Kind of a number text (0 plain, 1 bytes, 2 bits, 3 duration); null where it is no number."""
    number, unit = _parts(c)
    table = F.create_map(*[x for u, (k, _) in UNITS.items() for x in (F.lit(u), F.lit(k))])
    return F.when(number == "", None).when(unit == "", F.lit(NUMBER)).otherwise(F.try_element_at(table, unit)).cast("int")


def num_unit(c: Column) -> Column:
    """Value of a number text in its unit's base (bytes, bits per second, milliseconds); null where it is no number."""
    number, unit = _parts(c)
    table = F.create_map(*[x for u, (_, f) in UNITS.items() for x in (F.lit(u), F.lit(f))])
    value = F.regexp_replace(number, ",", ".").try_cast("double")
    factor = F.when(unit == "", F.lit(1.0)).otherwise(F.try_element_at(table, unit))
    return F.when(number != "", value * factor)


def parse_number(text: str) -> tuple[float, int] | None:
    """The same for one literal, at plan time."""
    m = re.match(_SHAPE, text.strip().lower())
    if not m or (m[2] and m[2] not in UNITS):
        return None
    kind, factor = UNITS.get(m[2], (NUMBER, 1.0))
    return float(m[1].replace(",", ".")) * factor, kind
