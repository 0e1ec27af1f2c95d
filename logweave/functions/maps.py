"""Enrichment maps: declarative definitions of rules and mappings, without code.

    definition = {"rules": [{"priority": 10, "selector": {"provider": "x", "event_id": "7"}, "when": "query", "mappings": [
        {"to": "user", "from": ["a", "b"], "steps": ["trim", "lower"], "type": "text", "on_missing": "keep" | "null" | "default", "default": "…"}]}]}
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.events import column_of
from logweave.functions.net import ipv4_number, ipv6_hex
from logweave.functions.text import blank
from logweave.functions.transforms import step
from logweave.plans.language import compile_query

SELECTORS = {"provider": "source", "channel": "channel", "event_id": "code", "version": "version"}


def value_step(c: Column, name: str) -> Column:
    """trim, lower, upper, basename, hex_to_int, the transforms, or strip_prefix:x, strip_suffix:x, remove_chars:x, replace:a:b."""
    head, _, rest = name.partition(":")
    match head:
        case "strip_prefix":
            return F.when(F.startswith(c, F.lit(rest)), F.substring(c, F.lit(len(rest) + 1), F.length(c))).otherwise(c)
        case "strip_suffix":
            return F.when(F.endswith(c, F.lit(rest)), F.substring(c, F.lit(1), F.length(c) - len(rest))).otherwise(c)
        case "remove_chars":
            return F.translate(c, rest, "")
        case "replace":
            a, _, b = rest.partition(":")
            return F.replace(c, F.lit(a), F.lit(b))
    return step(c, name)


def typed(c: Column, kind: str) -> Column:
    """The text of a value of a type, in one writing; null where it is none."""
    match kind:
        case "text":
            return c
        case "integer":
            return F.when(F.trim(c).rlike(r"^[+-]?\d{1,38}$"), F.trim(c).try_cast("decimal(38,0)").cast("string"))
        case "decimal":
            return F.when(F.trim(c).rlike(r"^[+-]?\d+(?:\.\d+)?$"), F.trim(c).try_cast("double").cast("string"))
        case "boolean":
            return F.when(F.lower(F.trim(c)).isin("true", "yes", "1", "sim"), "true").when(F.lower(F.trim(c)).isin("false", "no", "0", "não"), "false")
        case "datetime":
            return F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
        case "ip":
            return F.when(ipv4_number(c).isNotNull() | ipv6_hex(c).isNotNull(), F.trim(c))
    raise ValueError(f"unknown type {kind!r}")


def apply_map(df: DataFrame, definition: dict) -> DataFrame:
    """The mapped fields as columns; of several rules the one of highest priority, then of most selectors, that gives a value holds."""
    options: dict[str, list[tuple[tuple, Column]]] = {}
    for order, rule in enumerate(definition["rules"]):
        holds = compile_query(df, rule.get("when", ""))
        for name, wanted in rule.get("selector", {}).items():
            holds = holds & F.coalesce(column_of(df, SELECTORS[name]).cast("string") == str(wanted), F.lit(False))
        for m in rule["mappings"]:
            raw = F.coalesce(*[F.when(~blank(column_of(df, x).cast("string")), column_of(df, x).cast("string")) for x in m["from"]])
            value = raw
            for s in m.get("steps", []):
                value = value_step(value, s)
            value = typed(value, m.get("type", "text"))
            if m.get("on_invalid") == "keep":
                value = F.coalesce(value, raw)
            if m.get("on_missing") == "default":
                value = F.coalesce(value, F.lit(m["default"]))
            rank = (-rule.get("priority", 0), -len(rule.get("selector", {})), order)
            options.setdefault(m["to"], []).append((rank, F.when(holds, value)))
    return df.withColumns({to: F.coalesce(*[c for _, c in sorted(choices, key=lambda x: x[0])]) for to, choices in options.items()})


def shape(c: Column) -> Column:
    """The shape of a text: letters a, digits 9, runs shortened."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{L}+", "a"), r"[0-9]+", "9"), r"\s+", " ")


def shapes(df: DataFrame, column: str, top: int = 50) -> DataFrame:
    """The most frequent shapes of a field with an example: shape, n, example."""
    c = column_of(df, column).cast("string")
    return df.where(c.isNotNull()).groupBy(shape(c).alias("shape")).agg(F.count("*").alias("n"), F.min(c).alias("example")).orderBy(F.desc("n"), "shape").limit(top)


def coverage(df: DataFrame, definition: dict) -> DataFrame:
    """How many events get a value of each mapped field: field, filled, total."""
    names = sorted({m["to"] for r in definition["rules"] for m in r["mappings"]})
    done = apply_map(df, definition)
    got = done.agg(F.count("*").alias("total"), *[F.count(F.col(f"`{n}`")).alias(f"__{k}") for k, n in enumerate(names)])
    return got.select("total", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"__{k}").alias("filled")) for k, n in enumerate(names)])).alias("x")).select("x.field", "x.filled", "total")


def spans(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Places of an expression's matches: start, end (characters), start16, end16 (UTF-16 units), text, groups; null for null.

    Looked for batch by batch, so that lookarounds and word borders hold as in the whole text; empty matches are left out.
    """
    compiled = regex.compile(pattern, regex.I if ignore_case else 0)

    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s.tolist():
            if t is None:
                out.append(None)
                continue
            found = []
            for m in compiled.finditer(t):
                if m[0]:
                    a = m.start() + sum(x > "\uffff" for x in t[: m.start()])
                    found.append((m.start(), m.end(), a, a + len(m[0]) + sum(x > "\uffff" for x in m[0]), m[0], list(m.groups())))
            out.append(found)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<start: int, end: int, start16: int, end16: int, text: string, groups: array<string>>>")(c)
