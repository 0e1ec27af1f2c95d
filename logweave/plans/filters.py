"""Filter chips compiled to one Column: a list of filters is a conjunction.

Positive operators don't hold on missing values, negative ones (``not_*`` and ``empty``) do.  A positive condition is left null
there, which counts as no: plain comparisons so stay in a form that reaches the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.events import column_of
from logweave.functions.net import in_nets
from logweave.functions.text import ascii_lower, blank, pattern_of, tokens
from logweave.functions.units import num_unit, parse_number


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: str = ""
    value2: str = ""


def unicode_regex(pattern: str) -> str:
    """A pattern with Unicode classes and case folding, as the search language means it."""
    return "(?U)" + pattern


def _split(value: str) -> list[str]:
    return [x.strip() for x in re.split(r"[\n\r,]", value) if x.strip()]


def _bound(c: Column, value: str) -> tuple[Column, Column]:
    """(comparable column, literal) of a bound: an instant if it was typed as a date, else a number with unit."""
    if re.match(r"^\d{4}-\d\d-\d\d", value.strip()):
        return c.cast("long"), F.unix_millis(F.to_timestamp(F.lit(value.strip())))
    got = parse_number(value)
    if got is None:
        raise ValueError(f"no number or date: {value!r}")
    return num_unit(c.cast("string")), F.lit(got[0])


def condition(df: DataFrame, f: Filter) -> Column:
    if f.op == "query":
        from logweave.plans.language import compile_query

        return compile_query(df, f.value)
    if f.op in ("threat_rule", "detection"):
        from logweave.operators.rules import selects, threat_condition

        return threat_condition(df, f.value) if f.op == "threat_rule" else selects(df, f.value)
    if f.column == "_all":
        c = F.concat_ws("\n", column_of(df, "message"), column_of(df, "raw"))
    else:
        c = column_of(df, f.column)
    t = c.cast("string")
    match f.op:
        case "contains":
            return F.contains(F.lower(t), F.lit(f.value.lower()))
        case "equals":
            return ascii_lower(t) == ascii_lower(F.lit(f.value.strip()))
        case "equals_exact":
            return t == f.value
        case "starts_with":
            return F.startswith(ascii_lower(t), ascii_lower(F.lit(f.value)))
        case "regex":
            return F.coalesce(t, F.lit("")).rlike(unicode_regex(f.value))
        case "gt" | "gte" | "lt" | "lte":
            a, b = _bound(c, f.value)
            test = {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[f.op]
            return test
        case "between":
            (a, lo), (_, hi) = _bound(c, f.value), _bound(c, f.value2)
            return (a >= lo) & (a <= hi)
        case "empty":
            return blank(t)
        case "in":
            return F.lower(F.trim(t)).isin([x.lower() for x in _split(f.value)])
        case "in_exact":
            return t.isin([x for x in f.value.split("\n") if x])
        case "cidr":
            return in_nets(t, _split(f.value))
        case "term":
            words = [w for w in re.split(r"[\W_]+", f.value.lower()) if w]
            if not 1 <= len(words) <= 16:
                raise ValueError("a term filter takes 1 to 16 words")
            return F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(tokens(t), w))
        case "search":  # value2: any of the letters i (ignore case), m, s, and l for line scope
            flags = "".join(x for x in "ims" if x in f.value2)
            pattern = unicode_regex(f"(?{flags}{'u' if 'i' in flags else ''})" * bool(flags) + f.value)
            if "l" in f.value2:
                return F.exists(F.split(F.coalesce(t, F.lit("")), "\n"), lambda x: x.rlike(pattern))
            return F.coalesce(t, F.lit("")).rlike(pattern)
        case "pattern":
            return pattern_of(t) == f.value
    if f.op.startswith("not_"):
        return ~F.coalesce(condition(df, Filter(f.column, f.op[4:], f.value, f.value2)), F.lit(False))
    raise ValueError(f"unknown filter {f.op!r}")


def compile_filters(df: DataFrame, filters: list[Filter]) -> Column:
    """The conjunction; null counts as no."""
    out = F.lit(True)
    for f in filters:
        out = out & condition(df, f)
    return out


def apply(df: DataFrame, *filters: Filter, results: DataFrame | None = None) -> DataFrame:
    """Events that pass all filters.

    A filter ``finding`` or ``episode`` keeps the members of a computed result: ``results`` has event_ref (or id) and the column
    ``finding`` or ``episode``; the members may be many, so Spark chooses how to join.
    """
    for f in filters:
        if f.op in ("finding", "episode"):
            if results is None:
                raise ValueError(f"a filter {f.op} needs the computed results")
            key = "event_ref" if "event_ref" in results.columns and "event_ref" in df.columns else "id"
            df = df.join(results.where(F.col(f.op) == f.value).select(key).distinct(), key, "left_semi")
    return df.where(compile_filters(df, [f for f in filters if f.op not in ("finding", "episode")]))


def without_excluded(df: DataFrame, excluded: DataFrame, key: str = "event_ref") -> DataFrame:
    """Events that aren't excluded; the exclusions may be many, so Spark chooses how to join."""
    return df.join(excluded.select(key).distinct(), key, "left_anti")
