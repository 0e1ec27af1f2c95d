"""Sigma rules to Columns and detections."""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.events import column_of
from logweave.functions.net import in_nets
from logweave.functions.units import num_unit, parse_number
from logweave.operators.detect import distinct, sequence, threshold


def _wild(text: str, cased: bool, start: bool = True, end: bool = True) -> str:
    out, k = "", 0
    while k < len(text):
        c = text[k]
        if c == "\\" and text[k + 1 : k + 2] in ("*", "?", "\\"):
            out, k = out + re.escape(text[k + 1]), k + 1
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        k += 1
    return ("(?s)" if cased else "(?isu)") + ("^" if start else "") + out + ("$" if end else "")


def _value(c: Column, df: DataFrame, value, mods: list[str]) -> Column:
    cased = "cased" in mods
    if value is None:
        return c.isNull()
    if "exists" in mods:
        return c.isNotNull() if value else c.isNull()
    if "fieldref" in mods:
        return c == column_of(df, str(value)).cast("string")
    if "cidr" in mods:
        return in_nets(c, [str(value)])
    for op in ("gte", "gt", "lte", "lt"):
        if op in mods:
            bound = parse_number(str(value))[0]
            n = num_unit(c)
            return {"gt": n > bound, "gte": n >= bound, "lt": n < bound, "lte": n <= bound}[op]
    if "re" in mods:
        flags = "".join(f for f in "ims" if f in mods)
        return c.rlike((f"(?{flags})" if flags else "") + str(value))
    text = str(value)
    if isinstance(value, bool):
        text = text.lower()
    if "windash" in mods:
        spellings = {text} | {re.sub(r"(?<!\w)[-/–—―](?=\w)", d, text) for d in "-/–—―"}
        rest = [m for m in mods if m != "windash"]
        out = F.lit(False)
        for s in sorted(spellings):
            out = out | _value(c, df, s, rest)
        return out
    encoding = "utf-16-le" if {"utf16le", "wide", "utf16"} & set(mods) else "utf-16-be" if "utf16be" in mods else "utf-8"
    if "base64" in mods:
        return F.contains(c, F.lit(base64.b64encode(text.encode(encoding)).decode().rstrip("=")))
    if "base64offset" in mods:
        raw, out = text.encode(encoding), F.lit(False)
        for k in range(3):
            made = base64.b64encode(b"\0" * k + raw).decode()[(0, 2, 3)[k] :]
            cut = (len(raw) + k) % 3
            out = out | F.contains(c, F.lit(made[: -(0, 3, 2)[cut] or None].rstrip("=")))
        return out
    if "contains" in mods:
        return c.rlike(_wild(text, cased, False, False))
    if "startswith" in mods:
        return c.rlike(_wild(text, cased, True, False))
    if "endswith" in mods:
        return c.rlike(_wild(text, cased, False, True))
    return c.rlike(_wild(text, cased))


def _selection(df: DataFrame, sel) -> Column:
    if isinstance(sel, list):
        if all(not isinstance(x, dict) for x in sel):  # keywords
            whole = F.concat_ws("\n", *[F.col(f"`{n}`") for n, t in df.dtypes if t == "string"])
            parts = [F.contains(F.lower(whole), F.lit(str(x).lower())) for x in sel]
        else:
            parts = [_selection(df, x) for x in sel]
        out = F.lit(False)
        for p in parts:
            out = out | F.coalesce(p, F.lit(False))
        return out
    out = F.lit(True)
    for key, value in sel.items():
        name, *mods = key.split("|")
        c = column_of(df, name).cast("string")
        values = value if isinstance(value, list) else [value]
        joined = F.lit("all" in mods)
        for v in values:
            one = F.coalesce(_value(c, df, v, mods), F.lit(False))
            joined = joined & one if "all" in mods else joined | one
        out = out & (~joined if "neq" in mods else joined)
    return out


def condition(df: DataFrame, detection: dict) -> Column:
    """The predicate of a rule's detection part."""
    named = {k: v for k, v in detection.items() if k not in ("condition", "timeframe")}
    text = detection["condition"]
    text = text[0] if isinstance(text, list) else text
    tokens = re.findall(r"\(|\)|[\w*]+", text.split("|")[0])
    at = 0

    def some(pattern: str) -> list[Column]:
        names = [n for n in named if not n.startswith("_")] if pattern == "them" else [n for n in named if re.fullmatch(pattern.replace("*", ".*"), n)]
        if not names:
            raise ValueError(f"no selection {pattern}")
        return [_selection(df, named[n]) for n in names]

    def atom() -> Column:
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "(":
            out = either()
            at += 1
            return out
        if t == "not":
            return ~atom()
        if t in ("1", "all", "any") and at < len(tokens) and tokens[at] == "of":
            parts = some(tokens[at + 1])
            at += 2
            out = parts[0]
            for p in parts[1:]:
                out = out & p if t == "all" else out | p
            return out
        return some(t)[0]

    def both() -> Column:
        nonlocal at
        out = atom()
        while at < len(tokens) and tokens[at] == "and":
            at += 1
            out = out & atom()
        return out

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == "or":
            at += 1
            out = out | both()
        return out

    return either()


def span_ms(text: str) -> int:
    return int(text[:-1]) * {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}[text[-1]]


def run(df: DataFrame, rule: dict) -> DataFrame:
    """Events of a rule, or for ``count() by`` the merged windows."""
    where = condition(df, rule["detection"])
    counted = re.search(r"\|\s*count\((\w*)\)(?:\s+by\s+([\w, ]+?))?\s*(>=|>|=)\s*(\d+)", str(rule["detection"]["condition"]))
    if not counted:
        return df.where(where)
    least = int(counted[4]) + (counted[3] == ">")
    by = [x.strip() for x in (counted[2] or "").split(",") if x.strip()] or ["source"]
    width = span_ms(str(rule["detection"].get("timeframe", "1h")))
    return distinct(df, where, by, counted[1], least, width) if counted[1] else threshold(df, where, by, least, width)


def correlate(df: DataFrame, rules: dict[str, dict], correlation: dict) -> DataFrame:
    """event_count, value_count, temporal and temporal_ordered correlations of rules."""
    parts = [condition(df, rules[r]["detection"]) for r in correlation["rules"]]
    by, width = correlation.get("group-by", ["source"]), span_ms(correlation["timespan"])
    any_of = parts[0]
    for p in parts[1:]:
        any_of = any_of | p
    need = correlation.get("condition", {})
    least = need.get("gte", need.get("gt", 0) + 1)
    match correlation["type"]:
        case "event_count":
            return threshold(df, any_of, by, least, width)
        case "value_count":
            return distinct(df, any_of, by, need["field"], least, width)
        case "temporal" | "temporal_ordered" as kind:
            return sequence(df, parts, by, width, kind == "temporal_ordered")
    raise ValueError(f"unknown correlation {correlation['type']!r}")
