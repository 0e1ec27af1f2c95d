"""Sorting, paging and neighbourhoods of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.events import LEVELS, column_of
from logweave.functions.units import num_unit


def sort_keys(df: DataFrame, column: str, descending: bool = False) -> list[Column]:
    """Numbers first by value, then texts by lower case; undated events as 0; levels by severity; ties by id."""
    turn = F.desc if descending else F.asc
    if column == "id":
        return [turn("id")]
    if column == "ts":
        return [turn(F.coalesce("ts", F.lit(0))), F.asc("id")]
    if column == "level":
        rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
        return [turn(F.coalesce(rank, F.lit(0))), F.asc("id")]
    text = column_of(df, column).cast("string")
    number = num_unit(text)
    return [turn(number.isNull()), turn(F.coalesce(number, F.lit(0.0))), turn(F.lower(F.coalesce(text, F.lit("")))), F.asc("id")]


def page(df: DataFrame, column: str = "id", descending: bool = False, offset: int = 0, limit: int = 100, columns: Sequence[str] | None = None) -> DataFrame:
    out = df.orderBy(*sort_keys(df, column, descending)).offset(offset).limit(limit)
    return out.select(*columns) if columns else out


def keyset_page(df: DataFrame, after: tuple[int, int] | None, descending: bool = False, limit: int = 100) -> DataFrame:
    """The page after the cursor (ts, id): only rows beyond it are sorted, and the sort keeps no more than the page."""
    t = F.coalesce("ts", F.lit(0))
    if after:
        # on the plain column, so that it reaches the scan; undated events count as 0
        at, ts, none = after[0], F.col("ts"), F.col("ts").isNull()
        beyond, tied = (ts < at if descending else ts > at), ts == at
        if (0 < at) if descending else (0 > at):
            beyond = beyond | none
        if at == 0:
            tied = tied | none
        df = df.where(beyond | (tied & (F.col("id") > after[1])))
    return df.orderBy(F.desc(t) if descending else F.asc(t), "id").limit(limit)


def trail(df: DataFrame, ident: int, before: int = 10, after: int = 10) -> DataFrame:
    """Events around one event in (ts, id) order, the event included."""
    center = df.where(F.col("id") == ident).select("ts", "id").first()
    if center is None:
        return df.limit(0)
    t = F.coalesce("ts", F.lit(0))
    at = center["ts"] or 0
    earlier = df.where((t < at) | ((t == at) & (F.col("id") < ident))).orderBy(F.desc(t), F.desc("id")).limit(before)
    later = df.where((t > at) | ((t == at) & (F.col("id") >= ident))).orderBy(t, "id").limit(after + 1)
    return earlier.unionByName(later)


def sample(df: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """A deterministic sample: the n rows of smallest hash.

    Tasks send only rows whose hash lies in a share of the range that holds about 1.5 samples, so that what is merged
    doesn't grow with the number of tasks; should that leave fewer than n, all rows take part.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id"), F.lit(seed)).cast("binary")), 1, 15), 16, 10).cast("long")  # 60 bits
    share = 1.5 * n / max(df.count(), 1)
    some = df.where(h < F.lit(int(share * 2**60))) if share < 1 else df
    if share < 1 and some.count() < n:
        some = df
    return some.orderBy(h, "id").limit(n)


def stratified(df: DataFrame, column: Column, n: int, seed: int = 7) -> DataFrame:
    """Of each value of a column (a level, a shape) the ``n`` rows of smallest hash; each of 64 shares of a value keeps n first, so that no value is one task."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id"), F.lit(seed)).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = df.withColumns({"__v": column, "__h": h}).withColumn("__p", F.pmod("__h", F.lit(64)))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__v", "__p").orderBy("__h", "id"))).where(F.col("__r") <= n)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("__v").orderBy("__h", "id"))).where(F.col("__r") <= n).drop("__v", "__h", "__p", "__r")


def context(df: DataFrame, part_file: str, at: int, radius: int = 20, order: str = "id") -> DataFrame:
    """Events of one file around a place."""
    return df.where((F.col("part_file") == part_file) & F.col(order).between(at - radius, at + radius)).orderBy(order)


def search_buckets(df: DataFrame, hit: Column, width: int) -> DataFrame:
    """Hits by time bucket, for a search that shows where its hits lie: start, hits."""
    return df.where(F.coalesce(hit, F.lit(False)) & F.col("ts").isNotNull()).groupBy((F.col("ts") - F.pmod("ts", F.lit(width))).alias("start")).agg(F.count("*").alias("hits"))


def context_seconds(df: DataFrame, ident: int, seconds: int, same: str = "") -> DataFrame:
    """Events within ``seconds`` of an event, of all or only those that agree with it in the column ``same``, in order of time."""
    one = df.where(F.col("id") == ident).select("ts", *([same] if same else [])).first()
    if one is None or one["ts"] is None:
        return df.limit(0)
    rows = df.where(F.col("ts").between(one["ts"] - seconds * 1000, one["ts"] + seconds * 1000))
    return (rows.where(F.col(same).eqNullSafe(F.lit(one[same]))) if same else rows).orderBy("ts", "id")


def combined(op: str, first: DataFrame, *others: DataFrame, key: str = "id") -> DataFrame:
    """Ids of selections put together: ``and`` (in all), ``or`` (in any), ``not`` (in the first and in none of the others)."""
    out = first.select(key).distinct()
    for other in others:
        ids = other.select(key)
        match op:
            case "and":
                out = out.join(ids, key, "left_semi")
            case "or":
                out = out.unionByName(ids).distinct()
            case "not":
                out = out.join(ids, key, "left_anti")
            case _:
                raise ValueError(f"unknown operation {op!r}")
    return out


def search_page(df: DataFrame, hit: Column, size: int, after: tuple[int, int] | None = None) -> DataFrame:
    """The next hits in order of (ts, id) after a cursor, the last hit's (ts, id) of the page before; undated hits aren't shown."""
    rows = df.where(F.coalesce(hit, F.lit(False)) & F.col("ts").isNotNull())
    if after is not None:
        rows = rows.where((F.col("ts") > after[0]) | ((F.col("ts") == after[0]) & (F.col("id") > after[1])))
    return rows.orderBy("ts", "id").limit(size)
