"""Fields by example: locators from marked samples, their check on other samples, and derived fields that say which rule gave them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from os.path import commonprefix

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.events import column_of
from logweave.functions.transforms import Rule
from logweave.plans.filters import compile_filters

#: Shapes of values, the narrowest first.
SHAPES = (r"\d+", r"[0-9A-Fa-f]+", r"\d+(?:\.\d+)+", r"[\w.-]+@[\w.-]+", r"\w+", r"[\w.:/@-]+", r"\S+", r".+?")


@dataclass(frozen=True)
class Example:
    """A sample text in which the characters from start to end (exclusive) are the wanted value."""

    text: str
    start: int
    end: int

    @property
    def value(self) -> str:
        return self.text[self.start : self.end]


def _found(pattern: str, text: str) -> str | None:
    m = re.search(pattern, text, re.S)
    return m[1] if m else None


def locators(examples: Sequence[Example], most: int = 5) -> list[str]:
    """Expressions, each with one group, that find the marked value of every example: what stands before and behind in all of them, and the value's shape.

    The ones with the shortest surroundings come first; none if the examples have nothing in common.
    """
    if not examples:
        return []
    if any(not 0 <= e.start < e.end <= len(e.text) for e in examples):
        raise ValueError("an example marks no text")
    before = commonprefix([e.text[: e.start][::-1] for e in examples])[::-1]
    behind = commonprefix([e.text[e.end :] for e in examples])
    at_start, at_end = all(e.start == 0 for e in examples), all(e.end == len(e.text) for e in examples)
    shape = next(s for s in SHAPES if all(re.fullmatch(s, e.value, re.S) for e in examples))

    # at most three lengths of surroundings on either side: the last word, the last two words, all of it
    def cut(text: str, left: bool) -> list[str]:
        words = re.findall(r"\s*\S+\s*", text)
        parts = ["".join(words[-k:]) if left else "".join(words[:k]) for k in (1, 2, len(words))] if words else [text]
        return list(dict.fromkeys(parts))

    out = []
    for a in cut(before, True):
        for b in cut(behind, False):
            pattern = ("^" if at_start else re.escape(a)) + f"({shape})" + ("$" if at_end else re.escape(b) if b else "")
            if pattern not in out and all(_found(pattern, e.text) == e.value for e in examples):
                out.append(pattern)
    return sorted(out, key=lambda p: (len(p), p))[:most]


def verify(pattern: str, samples: Sequence[str]) -> list[str | None]:
    """The value that a locator finds in each sample."""
    return [_found(pattern, s) if s is not None else None for s in samples]


def extract_by_example(df: DataFrame, column: str, name: str, examples: Sequence[Example]) -> DataFrame:
    """``df`` with the value that the best locator of the examples finds; null where it finds none."""
    got = locators(examples)
    if not got:
        raise ValueError("the examples have nothing in common")
    c = column_of(df, column).cast("string")
    return df.withColumn(name, F.when(c.rlike("(?s)" + got[0]), F.regexp_extract(c, "(?s)" + got[0], 1)))


def advanced_field(df: DataFrame, name: str, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with a field of the first rule whose result isn't empty, and the struct ``<name>_from``: rule (its number) and column."""
    options = []
    for k, r in enumerate(rules):
        c = column_of(df, r.column).cast("string")
        parts = re.split(r"\$(\d)", r.template)
        made = [F.regexp_extract(c, r.pattern, int(p)) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
        value = F.concat(*made) if made else F.lit("")
        hit = c.rlike(r.pattern) & compile_filters(df, list(r.filters)) & (F.trim(value) != "")
        options.append(F.when(hit, F.struct(value.alias("value"), F.lit(k).alias("rule"), F.lit(r.column).alias("column"))))
    rows = df.withColumn("__made", F.coalesce(*options))
    return rows.withColumn(name, F.col("__made.value")).withColumn(f"{name}_from", F.when(F.col("__made").isNotNull(), F.struct(F.col("__made.rule").alias("rule"), F.col("__made.column").alias("column")))).drop("__made")
