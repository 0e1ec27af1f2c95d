"""Sliding windows in milliseconds, islands and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from logweave.operators.ordered import with_previous, with_running


#: Length of a block of time in window widths: one row in so many is context of two blocks.
BLOCK_WIDTHS = 16


def span(by: Sequence[str], width: int) -> WindowSpec:
    """The events of a group in the last ``width`` milliseconds, the current one included."""
    return Window.partitionBy(*by).orderBy("ts").rangeBetween(-width, 0)


def with_sliding(df: DataFrame, by: Sequence[str], width: int, distinct: str = "", flag: Column | None = None, number: Column | None = None) -> DataFrame:
    """Counts, distinct values, flagged events and number statistics of the last ``width`` milliseconds."""
    rows, own = in_blocks(df, width)
    w = span([*by, "__b"], width)
    if distinct:
        rows = _counted_values(rows, by, width, distinct, "win_distinct")
    out = rows.withColumn("win_n", F.count("*").over(w))
    if flag is not None:
        out = out.withColumn("win_flagged", F.count_if(flag).over(w))
    if number is not None:
        out = out.withColumn("win_sum", F.sum(number).over(w)).withColumn("win_avg", F.avg(number).over(w))
        out = out.withColumn("win_min", F.min(number).over(w)).withColumn("win_max", F.max(number).over(w))
    return out.where(F.col("__b") == own).drop("__b")


def in_blocks(df: DataFrame, width: int) -> tuple[DataFrame, Column]:
    """Dated rows in blocks of time (column ``__b``) and the block that a row belongs to.

    A block holds the rows of its span and, as context, those of the ``width`` before it, so that no group is one task.
    """
    block = BLOCK_WIDTHS * max(width, 1)
    own = F.floor(F.col("ts") / block)
    into = F.when(F.pmod(F.col("ts"), F.lit(block)) >= block - width, F.array(own, own + 1)).otherwise(F.array(own))
    return df.where("ts is not null").withColumn("__b", F.explode(into)), own


def _counted_values(rows: DataFrame, by: Sequence[str], width: int, column: str, name: str) -> DataFrame:
    """The number of different values in the last ``width`` milliseconds.

    A value counts from each of its rows on for ``width``; where it stands again within that time, its spans are one.  The number of
    values at an instant is the number of spans that have begun less those that have ended: no row holds a set.  All windows are
    within (group, block), so that one shuffle serves them.
    """
    value, same = F.col(f"`{column}`"), Window.partitionBy(*by, "__b", F.col(f"`{column}`")).orderBy("ts")
    before, behind = F.lag("ts").over(same), F.lead("ts").over(same)
    rows = rows.repartition(*by, "__b")
    rows = rows.withColumn("__begun", (value.isNotNull() & (before.isNull() | (F.col("ts") - before > width))).cast("int"))
    rows = rows.withColumn("__ended", (value.isNotNull() & (behind.isNull() | (behind - F.col("ts") > width))).cast("int"))
    order = Window.partitionBy(*by, "__b").orderBy("ts")
    begun = F.sum("__begun").over(order.rangeBetween(Window.unboundedPreceding, 0))
    ended = F.sum("__ended").over(order.rangeBetween(Window.unboundedPreceding, -(width + 1)))
    return rows.withColumn(name, (begun - F.coalesce(ended, F.lit(0))).cast("int")).drop("__begun", "__ended")


def with_distinct(df: DataFrame, by: Sequence[str], width: int, column: str, name: str = "win_distinct") -> DataFrame:
    """``df`` with the number of different values of a column in the last ``width`` milliseconds; undated rows are left out."""
    rows, own = in_blocks(df, width)
    return _counted_values(rows, by, width, column, name).where(F.col("__b") == own).drop("__b")


def islands(df: DataFrame, by: Sequence[str], width: int, hit: Column) -> DataFrame:
    """Merged ranges of events whose window satisfies ``hit``: by, first, last, events, peak.

    A hit stands for its whole window; ranges that overlap or touch are one.
    """
    # a hit begins a range if none of the ``width`` before it is one: blocks with their context tell; ranges of blocks are then put together
    hits, own = in_blocks(df.where(hit).select(*by, "ts", "id", "win_n"), width)
    local = Window.partitionBy(*by, "__b").orderBy("ts", "id")
    before = F.lag("ts").over(local)
    hits = hits.withColumn("__start", F.when(before.isNull() | (F.col("ts") - before > width), F.col("ts"))).where(F.col("__b") == own)
    hits = hits.withColumn("__start", F.last("__start", True).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    parts = hits.groupBy(*by, "__b", "__start").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("hits"), F.max("win_n").alias("peak"))
    whole = F.last("__start", True).over(Window.partitionBy(*by).orderBy("__b", F.asc_nulls_first("__start")).rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("__start", whole)
    return parts.groupBy(*by, "__start").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("hits").alias("hits"), F.max("peak").alias("peak")).drop("__start")


def rising_edges(df: DataFrame, by: Sequence[str], hit: Column) -> DataFrame:
    """The events at which a condition begins to hold."""
    marked = with_previous(df.withColumn("__hit", F.coalesce(hit, F.lit(False))), by, {"__hit": "__was"})
    return marked.where(F.col("__hit") & ~F.coalesce("__was", F.lit(False))).drop("__hit", "__was")


def gaps(df: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """Silences of at least ``least`` milliseconds: by, gap_start, gap_end, gap_ms."""
    rows = with_previous(df, by, {"ts": "gap_start"}).where(F.col("ts") - F.col("gap_start") >= least)
    return rows.select(*by, "gap_start", F.col("ts").alias("gap_end"), (F.col("ts") - F.col("gap_start")).alias("gap_ms"))


def sequence_jumps(df: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """Record numbers of a writer that don't follow one another: by, ts, id, before, number, missing (negative where the number went back or stood still)."""
    rows = df.where(F.col(number).isNotNull()).withColumn("__n", F.col(number).cast("long"))
    rows = with_previous(rows, by, {"__n": "before"}).where((F.col("__n") != F.col("before") + 1))
    return rows.select(*by, "ts", "id", "before", F.col("__n").alias("number"), (F.col("__n") - F.col("before") - 1).alias("missing"))


def ranks(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        df.withColumn("row_number", F.row_number().over(w)).withColumn("rank", F.rank().over(w)).withColumn("dense_rank", F.dense_rank().over(w))
        .withColumn("percent_rank", F.round(F.percent_rank().over(w), 6)).withColumn("cume_dist", F.round(F.cume_dist().over(w), 6))
        .withColumn("ntile", F.ntile(4).over(w)).withColumn("first_id", F.first("id").over(full)).withColumn("last_id", F.last("id").over(full))
        .withColumn("third_id", F.nth_value("id", 3).over(full))
    )
