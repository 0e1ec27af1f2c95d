"""Text functions as Column expressions: folding, tokens, message patterns, entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text that stands for a masked token of a pattern.
MASK = "‹…›"
PATTERN_CHARS = 400
_MASKED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b|\b0x[0-9a-fA-F]+\b|\b[0-9a-fA-F]{12,}\b|\b[0-9]+(?:\.[0-9]+)?\b"
)


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(c, UPPER, LOWER)


def blank(c: Column) -> Column:
    """Null, empty or white space."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def pattern_of(message: Column) -> Column:
    """First line of a message with identifiers, addresses and numbers masked."""
    return F.substring(F.regexp_replace(F.substring_index(message, "\n", 1), _MASKED, MASK), 1, PATTERN_CHARS)


def tokens(c: Column) -> Column:
    """Lower-case words (runs of letters and digits)."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for empty text, null for null."""
    chars = F.split(c, "")
    n = F.length(c).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def iso(ms: Column) -> Column:
    """RFC 3339 text of epoch milliseconds; the fraction is written only where it isn't zero."""
    stamp = F.timestamp_millis(ms)
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.pmod(ms, F.lit(1000)) != 0, F.date_format(stamp, ".SSS")).otherwise(""), F.lit("+00:00"))
