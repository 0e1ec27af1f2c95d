"""Timestamps of any written form into epoch milliseconds, UTC.

Texts become shape masks (digits and letters as classes); each distinct mask is mapped once to the layouts that it can fit, mostly
one, and all texts of the mask are extracted and converted column-wise.  Wall times become instants through the transition tables of
``zones``: a wall time that occurs twice is its earlier instant, a skipped one moves on by the skipped span, which both
follow from holding the offset before a transition until the later of the two wall clocks has passed it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from logweave.operators.zones import Zones, edition, local

# Month names in English, Portuguese, Spanish, German, French and Italian.
MONTH_NAMES = (
    "jan january janeiro ene enero januar janvier gennaio gen jän",
    "feb february fev fevereiro febrero februar février fév févr febbraio",
    "mar march março marco marzo märz mär mars mrz",
    "apr april abr abril avril avr aprile",
    "may mai maio mayo maggio mag",
    "jun june junho junio juni juin giugno giu",
    "jul july julho julio juli juillet juil luglio lug",
    "aug august ago agosto août aou",
    "sep september set setembro septiembre sept septembre settembre",
    "oct october out outubro octubre okt oktober octobre ottobre ott",
    "nov november novembro noviembre novembre",
    "dec december dez dezembro dic diciembre dezember décembre déc dicembre",
)
MONTHS = {name: k for k, names in enumerate(MONTH_NAMES, 1) for name in names.split()}
# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "JST": 540, "KST": 540,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "BRT": -180, "BRST": -120, "ART": -180, "NST": -210, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,:](?P<f>\d{1,9}))?)?(?:\s?(?P<ap>[AaPp]\.?[Mm]\.?))?"
_ZONE = r"(?:\s?(?P<off>[Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2}))?(?:\s?(?P<abbr>[A-Z]{2,5}))?(?:\s?\[(?P<reg>[A-Za-z_]+(?:/[A-Za-z0-9_+-]+)*)\])?"
_AT = rf"(?:(?:[T ,]|\s)+{_TIME}{_ZONE})?"
_WEEKDAY = r"(?:\p{L}+\.?,?\s+)?"
#: Layouts in the order in which they are tried.
LAYOUTS = (
    rf"(?P<Y>\d{{4}})[-/.](?P<Mo>\d{{1,2}})[-/.](?P<d>\d{{1,2}}){_AT}",
    rf"(?P<a>\d{{1,2}})[-/.](?P<b>\d{{1,2}})[-/.](?P<Y>\d{{4}}|\d{{2}}){_AT}",
    rf"(?P<d>\d{{1,2}})/(?P<mon>\p{{L}}+)/(?P<Y>\d{{4}}):{_TIME}{_ZONE}",
    rf"{_WEEKDAY}(?P<mon>\p{{L}}+)\.?\s+(?P<d>\d{{1,2}})\s+{_TIME}(?:\s(?P<off>[+-]\d{{2}}:?\d{{2}}))?(?:\s(?P<abbr>[A-Z]{{2,5}}))?\s(?P<Y>\d{{4}})",
    rf"{_WEEKDAY}(?P<mon>\p{{L}}+)\.?\s+(?P<d>\d{{1,2}}),\s+(?P<Y>\d{{4}}){_AT}",
    rf"{_WEEKDAY}(?P<d>\d{{1,2}})\.?\s+(?:de\s+)?(?P<mon>\p{{L}}+)\.?,?\s+(?:de\s+)?(?P<Y>\d{{4}}){_AT}",
    rf"{_WEEKDAY}(?P<mon>\p{{L}}+)\.?\s+(?P<d>\d{{1,2}})\s+{_TIME}{_ZONE}",
    rf"(?P<Y>\d{{4}})(?P<Mo>\d{{2}})(?P<d>\d{{2}})[T ]?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?{_ZONE}",
    rf"(?P<Mo>\d{{2}})(?P<d>\d{{2}})\s+{_TIME}{_ZONE}",
    rf"{_TIME}{_ZONE}",
    r"(?P<e>-?\d{9,19})(?:\.(?P<f>\d+))?",
)
_ANCHORED = tuple(rf"^{x}$" for x in LAYOUTS)
_MISSING = np.iinfo(np.int64).min


def _on_masks(layout: str) -> str:
    """A layout as an expression over masks, where a digit is 9 and a run of letters is a: all texts that fit the layout have masks that fit it."""
    for text, mask in (
        (r"\p{L}+", "a"), (r"[AaPp]\.?[Mm]\.?", r"a\.?(?:a\.?)?"), ("[Zz]", "a"), ("[A-Z]{2,5}", "a"), (r"[A-Za-z_]+(?:/[A-Za-z0-9_+-]+)*", r"[a_]+(?:/[a9_+-]+)*"),
        (r"(?:de\s+)?", r"(?:a\s+)?"), ("[T ,]", "[a ,]"), ("[T ]", "[a ]"), (r"\d", "9"),
    ):
        layout = layout.replace(text, mask)
    return layout


_MASKED = tuple(re.compile(_on_masks(x)) for x in LAYOUTS)


@lru_cache(maxsize=100_000)
def layouts_of(mask: str) -> tuple[int, ...]:
    """The layouts that texts of a mask can fit, in the order in which they are tried."""
    return tuple(k for k, pattern in enumerate(_MASKED) if pattern.fullmatch(mask))


def epoch_to_ms(value: Column) -> Column:
    """Epoch milliseconds of an integer in seconds, milli-, micro- or nanoseconds, told by its size; 0 and null are missing."""
    v, size = value.cast("long"), F.abs(value.cast("double"))
    ms = F.when(size < 1e11, v * 1000).when(size < 1e14, v).when(size < 1e17, F.floor(v / F.lit(1000).cast("decimal(20,0)")).cast("long"))
    return F.when(v != 0, ms.otherwise(F.floor(v / F.lit(1000000).cast("decimal(20,0)")).cast("long")))


def _ints(groups: dict, name: str, n: int, default: int = 0) -> np.ndarray:
    if name not in groups:
        return np.full(n, default, np.int64)
    return pc.cast(pc.if_else(pc.equal(groups[name], ""), str(default), groups[name]), pa.int64()).to_numpy(zero_copy_only=False)


def _convert(texts: pa.Array, k: int, zone: np.ndarray, year: np.ndarray, date: np.ndarray, day_first: np.ndarray, zones: Zones) -> tuple[np.ndarray, np.ndarray]:
    """(milliseconds, extracted or not) of texts in layout k; _MISSING names no real time."""
    got = pc.extract_regex(texts, _ANCHORED[k])
    fits = pc.is_valid(got).to_numpy(zero_copy_only=False)
    out = np.full(len(texts), _MISSING, np.int64)
    if not fits.any():
        return out, fits
    rows = np.flatnonzero(fits)
    got = got.take(pa.array(rows))
    g, n = {f.name: pc.struct_field(got, f.name) for f in got.type}, len(rows)
    fraction = pc.fill_null(g["f"], "") if "f" in g else pa.array([""] * n)
    milli = pc.cast(pc.utf8_slice_codeunits(pc.binary_join_element_wise(fraction, "000", ""), 0, 3), pa.int64()).to_numpy(zero_copy_only=False)
    if "e" in g:
        whole = g["e"].to_pylist()
        for i, (e, m) in enumerate(zip(whole, milli)):
            v = int(e)
            size = abs(v)
            out[rows[i]] = v * 1000 + int(m) if size < 10**11 else v if size < 10**14 else v // 1000 if size < 10**17 else v // 10**6
        return out, fits
    zone, year, date, day_first = zone[rows], year[rows], date[rows], day_first[rows]
    good = np.ones(n, bool)
    if "a" in g:
        a, b = _ints(g, "a", n), _ints(g, "b", n)
        first = day_first != 0  # unknown (-1) counts as day first
        day, month = np.where(first, a, b), np.where(first, b, a)
    elif "d" in g:
        day = _ints(g, "d", n)
        if "mon" in g:
            names = [MONTHS.get(x.lower(), 0) for x in g["mon"].to_pylist()]
            month = np.array(names, np.int64)
        else:
            month = _ints(g, "Mo", n)
    else:
        days = date.astype("datetime64[D]")
        good &= ~np.isnat(days)
        day = month = None
    if day is not None:
        years = _ints(g, "Y", n, -1)
        years = np.where(years < 0, year, np.where(years < 100, years + 2000, years)) if "Y" in g else year
        good &= (years >= 1) & (years <= 9999) & (month >= 1) & (month <= 12)
        m = ((np.where(good, years, 1970) - 1970) * 12 + np.where(good, month, 1) - 1).astype("datetime64[M]")
        days = m.astype("datetime64[D]") + (day - 1)
        good &= (day >= 1) & (days.astype("datetime64[M]") == m)
    h, mi, s = _ints(g, "h", n), _ints(g, "mi", n), _ints(g, "s", n)
    if "ap" in g:
        half = pc.utf8_lower(pc.utf8_slice_codeunits(g["ap"], 0, 1)).to_numpy(zero_copy_only=False)
        told = half != ""
        good &= ~told | ((h >= 1) & (h <= 12))
        h = np.where(told, h % 12 + np.where(half == "p", 12, 0), h)
    good &= (h <= 23) & (mi <= 59) & (s <= 59)
    wall = np.where(good, days.astype(np.int64), 0) * 86400 + h * 3600 + mi * 60 + s
    fixed = np.full(n, _MISSING, np.int64)
    region = zone.copy()
    if "off" in g:
        for text in set(g["off"].to_pylist()) - {""}:
            digits = text[1:].replace(":", "")
            minutes = 0 if text in "Zz" else (1 if text[0] == "+" else -1) * (int(digits[:2]) * 60 + int(digits[2:] or 0))
            fixed[pc.equal(g["off"], text).to_numpy(zero_copy_only=False)] = minutes * 60
    if "abbr" in g:
        for text in set(g["abbr"].to_pylist()) - {""}:
            here = pc.equal(g["abbr"], text).to_numpy(zero_copy_only=False) & (fixed == _MISSING)
            if text in ABBREVIATIONS:
                fixed[here] = ABBREVIATIONS[text] * 60
            elif zones.get(text) is not None:
                region[here] = text
            else:
                good[here] = False
    if "reg" in g:
        named = g["reg"].to_numpy(zero_copy_only=False)
        region = np.where(named != "", named, region)
    utc = wall - np.where(fixed == _MISSING, 0, fixed)
    open_ = fixed == _MISSING
    for z in set(region[open_].tolist()):
        here = open_ & (region == z)
        if (table := zones.get(z or "UTC")) is None:
            good[here] = False
        else:
            utc[here] = table.to_utc(wall[here])
    out[rows] = np.where(good, utc * 1000 + milli, _MISSING)
    return out, fits


def instants(texts: pd.Series, zone: pd.Series, year: pd.Series, date: pd.Series, day_first: pd.Series, zones: Zones | None = None) -> pd.Series:
    """Epoch milliseconds of a batch of written stamps; null where a text names no real date and time."""
    zones = zones or local()
    t = pc.utf8_trim_whitespace(pc.fill_null(pa.array(texts, pa.string(), from_pandas=True), ""))
    masks = pc.replace_substring_regex(pc.replace_substring_regex(t, r"\d", "9"), r"\p{L}+", "a").dictionary_encode()
    codes, shapes = masks.indices.to_numpy(), masks.dictionary.to_pylist()
    z = zone.fillna("UTC").astype(str).to_numpy(object)
    y = pd.to_numeric(year, errors="coerce").fillna(-1).to_numpy(np.int64)
    d = pd.to_datetime(date, errors="coerce").to_numpy("datetime64[ns]")
    df = day_first.map({True: 1, False: 0}).fillna(-1).to_numpy(np.int64)
    out = np.full(len(texts), _MISSING, np.int64)
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(shapes) + 1))
    for code, mask in enumerate(shapes):
        left = order[bounds[code] : bounds[code + 1]]
        for k in layouts_of(mask):
            if not len(left):
                break
            ms, fits = _convert(t.take(pa.array(left)), k, z[left], y[left], d[left], df[left], zones)
            out[left[fits]] = ms[fits]
            left = left[~fits]
    return pd.Series(out).mask(out == _MISSING).astype("Int64")


def _sent_zones():
    """The zone data of this session's context, sent to its executors once."""
    context = SparkSession.active().sparkContext
    if not hasattr(context, "_logweave_zones"):
        context._logweave_zones = context.broadcast(edition()[1])
    return context._logweave_zones


@lru_cache(maxsize=2)
def _unpacked(packed: bytes) -> Zones:
    return Zones(packed)


def to_epoch_ms(text: str, zone: str, year: str, date: str, day_first: str) -> Column:
    """Column of epoch milliseconds of the stamps in column ``text``.

    zone, year, date and day_first name the columns that hold the file's zone (null: UTC), the year of dates without one, the
    date of times without one, and the order of numeric day and month (null: day first).  Finer digits are cut off; a date
    alone means 00:00; a written offset beats an abbreviation, an abbreviation a region name, a region name the file's zone.
    Null, empty and impossible stamps give null.  The edition of the zone data stands in the column's metadata as ``zone_version``.
    """
    sent = _sent_zones()

    def convert(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        zones = _unpacked(sent.value)
        for b in batches:
            yield instants(*b, zones=zones)

    made = F.pandas_udf(convert, "long").asNondeterministic()(*(F.col(c) for c in (text, zone, year, date, day_first)))
    return made.alias("epoch_ms", metadata={"zone_version": edition()[0]})
