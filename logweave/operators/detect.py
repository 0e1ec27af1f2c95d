"""Detections: single, threshold, distinct, ratio, aggregate, beacon, behaviours, and ordered sequences.

Windowed rules are plans over range frames in blocks of time.  Sequence and temporal rules match events one by one and consume them: only the
events that some step selects are shuffled, cut into independent stretches where more than the window lies between
neighbours.  A stretch without such a gap is read in order by one task, which holds no more than a window of it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.aggregates import percentiles
from logweave.operators.ordered import carried, with_previous, with_running
from logweave.operators.sliding import BLOCK_WIDTHS, in_blocks, islands, with_sliding


def single(df: DataFrame, where: Column, unless: Column | None = None) -> DataFrame:
    return df.where(where if unless is None else where & ~F.coalesce(unless, F.lit(False)))


def threshold(df: DataFrame, where: Column, by: Sequence[str], count: int, width: int) -> DataFrame:
    """At least ``count`` events in a window, overlapping windows merged."""
    return islands(with_sliding(df.where(where), by, width), by, width, F.col("win_n") >= count)


def distinct(df: DataFrame, where: Column, by: Sequence[str], column: str, count: int, width: int) -> DataFrame:
    """At least ``count`` different values in a window."""
    return islands(with_sliding(df.where(where & F.col(column).isNotNull()), by, width, column), by, width, F.col("win_distinct") >= count)


def ratio(df: DataFrame, numerator: Column, denominator: Column, by: Sequence[str], at_least: float, width: int, least: int = 2) -> DataFrame:
    """Events at which the share of numerator events in a window is at least ``at_least``."""
    rows = with_sliding(df.where(denominator), by, width, flag=numerator)
    return rows.withColumn("ratio", F.col("win_flagged") / F.col("win_n")).where((F.col("win_n") >= least) & (F.col("ratio") >= at_least))


def sliding_aggregate(df: DataFrame, where: Column, by: Sequence[str], number: Column, kind: str, at_least: float, width: int) -> DataFrame:
    rows = with_sliding(df.where(where), by, width, number=number)
    return rows.where(F.col(f"win_{kind}") >= at_least)


def beacon(df: DataFrame, by: Sequence[str], count: int = 6, least_gap: int = 10_000, share: float = 0.8, spread: float = 0.2, floor: int = 2000) -> DataFrame:
    """Groups whose gaps are regular: by, hits, median_gap, regular (share of gaps near the median)."""
    rows = with_previous(df.select(*by, "ts", "id"), by, {"ts": "__last"})
    rows = rows.withColumn("gap", F.col("ts") - F.col("__last")).drop("__last").where("gap is not null").withColumn("__g", F.concat_ws("\x1f", *by))
    medians = percentiles(rows, "gap", "__g", (0.5,)).withColumnRenamed("n", "gaps")
    near = F.abs(F.col("gap") - F.col("p50")) <= F.greatest(F.col("p50") * spread, F.lit(floor))
    out = rows.join(medians, "__g").groupBy(*by).agg((F.count("*") + 1).alias("hits"), F.max("p50").alias("median_gap"), F.round(F.avg(near.cast("double")), 6).alias("regular"))
    return out.where((F.col("hits") >= max(count, 6)) & (F.col("median_gap") >= least_gap) & (F.col("regular") >= share))


def new_value(df: DataFrame, by: Sequence[str], column: str, history: int = 5) -> DataFrame:
    """First events of a value that come after at least ``history`` events of their group."""
    rows = df.where(F.col(column).isNotNull() & F.col("ts").isNotNull())
    rows = with_running(rows, by, F.lit(1), "__upto").withColumn("prior", (F.col("__upto") - 1).cast("int"))
    first = rows.groupBy(*by, column).agg(F.min(F.struct("ts", "id", "prior")).alias("f"))
    return first.select(*by, column, "f.*").where(F.col("prior") >= history)


def appeared(df: DataFrame, key: str, status: str, misses: int = 3) -> DataFrame:
    """Keys that answered 404 or 410 at least ``misses`` times before their first success."""
    rows = df.where("ts is not null").withColumn("ok", F.col(status).between(200, 299)).withColumn("gone", F.col(status).isin(404, 410))
    first = rows.groupBy(key).agg(F.min(F.when(F.col("ok"), F.struct("ts", "id"))).alias("f")).where("f is not null")
    before = rows.join(first, key).where("gone and struct(ts, id) < f")
    return before.groupBy(key).agg(F.count("*").alias("misses"), F.max("f.ts").alias("appeared")).where(F.col("misses") >= misses)


def size_outlier(df: DataFrame, by: str, size: str, factor: float = 10, plus: int = 4096, least: int = 20) -> DataFrame:
    """Events whose size is ``factor`` times the median of their group and ``plus`` above it."""
    base = percentiles(df, size, by, (0.5,)).where(F.col("n") >= least).select(by, F.col("p50").alias("median"))
    return df.join(base, by).where((F.col(size) >= F.col("median") * factor) & (F.col(size) >= F.col("median") + plus))


def new_endpoint(df: DataFrame, key: str, source: str, method: str, sources: int = 2, requests: int = 3, after: float = 0.1, posts: float = 0.5, span: int = 3_600_000) -> DataFrame:
    """Endpoints that few sources use, mostly to send, and that appear late."""
    whole = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    if whole["a"] is None or whole["b"] - whole["a"] < span:
        return df.select(key).limit(0).withColumn("requests", F.lit(0).cast("long")).withColumn("sources", F.lit(0).cast("long")).withColumn("first", F.lit(0).cast("long"))
    out = df.groupBy(key).agg(F.count("*").alias("requests"), F.count_distinct(source).alias("sources"), F.min("ts").alias("first"), F.avg(F.col(method).isin("POST", "PUT").cast("double")).alias("sent"))
    return out.where((F.col("requests") >= requests) & (F.col("sources") <= sources) & (F.col("sent") >= posts) & (F.col("first") >= whole["a"] + after * (whole["b"] - whole["a"]))).drop("sent")


def travel(df: DataFrame, by: Sequence[str], lat: str, lon: str, speed: float = 1000, distance: float = 500) -> DataFrame:
    """Moves of at least ``distance`` km between consecutive events at more than ``speed`` km/h."""
    from logweave.functions.net import haversine_km

    rows = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    rows = with_previous(rows, by, {"ts": "__ts", lat: "__lat", lon: "__lon"})
    rows = rows.withColumn("km", haversine_km(F.col("__lat"), F.col("__lon"), F.col(lat), F.col(lon))).withColumn("hours", (F.col("ts") - F.col("__ts")) / 3_600_000)
    return rows.where((F.col("km") >= distance) & (F.col("km") > F.col("hours") * speed)).drop("__ts", "__lat", "__lon")


def _match(rows: Iterable[tuple], steps: int, width: int, ordered: bool) -> Iterator[tuple]:
    """Matches of one stretch of (ts, id, steps); each event serves one step of one match; equal instants don't prove an order."""
    queues: list[deque] = [deque() for _ in range(steps)]
    for ts, ident, mine in rows:
        for q in queues:
            while q and ts - q[0][0] > width:
                q.popleft()
        for k in range(steps):
            if mine >> k & 1:
                queues[k].append((ts, ident))
        if chain := _chain(queues, ordered):
            yield chain[0][0], chain[-1][0], [c[1] for c in chain]
            for q in queues:
                q.clear()


def _chain(queues: Sequence[Iterable[tuple]], ordered: bool) -> list[tuple] | None:
    if any(not q for q in queues):
        return None
    if ordered:
        out: list[tuple] = []
        for q in queues:
            nxt = next((e for e in q if not out or e[0] > out[-1][0]), None)
            if nxt is None:
                return None
            out.append(nxt)
        return out
    taken: dict[tuple, int] = {}  # bipartite assignment of different events to the steps

    def assign(k: int, seen: set) -> bool:
        for e in queues[k]:
            if e not in seen:
                seen.add(e)
                if e not in taken or assign(taken[e], seen):
                    taken[e] = k
                    return True
        return False

    if not all(assign(k, set()) for k in range(len(queues))):
        return None
    return sorted(taken)


def sequence(df: DataFrame, steps: Sequence[Column], by: Sequence[str], width: int, ordered: bool = True) -> DataFrame:
    """Matches of steps within a window, in strict order of time or in any order: by, first, last, events (ids).

    Events are consumed: after a match the search starts afresh.
    """
    bits = F.lit(0)
    for k, s in enumerate(steps):
        bits = bits + F.when(F.coalesce(s, F.lit(False)), 1 << k).otherwise(0)
    rows = df.where("ts is not null").select(*by, "ts", "id", bits.alias("steps")).where("steps > 0")
    # a stretch is named by its first time; blocks with their context tell where one begins, the last one of the blocks before is carried in
    rows, own = in_blocks(rows, width)
    local = Window.partitionBy(*by, "__b").orderBy("ts", "id")
    before = F.lag("ts").over(local)
    rows = rows.withColumn("__begin", F.when(before.isNull() | (F.col("ts") - before > width), F.col("ts"))).where(F.col("__b") == own)
    rows = rows.withColumn("__begin", F.last("__begin", True).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*by, "__b").agg(F.max("__begin").alias("__end"))
    ends = ends.withColumn("__carry", F.last("__end", True).over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__end")
    rows = carried(rows, ends, by).withColumn("__stretch", F.coalesce("__begin", "__carry"))
    kinds = ", ".join(f"`{b}` {dict(rows.dtypes)[b]}" for b in by)
    names, count, keys = [*by, "first", "last", "events"], len(steps), [*by, "__stretch"]

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (r for b in batches for r in zip(*(b[c].tolist() for c in (*keys, "ts", "id", "steps"))))
        found = []
        for key, group in groupby(stream, lambda r: r[: len(keys)]):
            found += [(*key[:-1], *m) for m in _match((r[len(keys) :] for r in group), count, width, ordered)]
            if len(found) >= 10_000:
                yield pd.DataFrame(found, columns=names)
                found = []
        yield pd.DataFrame(found, columns=names)

    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "ts", "id").select(*keys, "ts", "id", "steps")
    return rows.mapInPandas(match, f"{kinds}, first long, last long, events array<long>")


def absence(df: DataFrame, anchor: Column, expected: Column, by: Sequence[str], width: int, covered_until: int) -> DataFrame:
    """Anchors without the expected event within the window, only where the data are known to be complete until ``covered_until``."""
    rows = df.where("ts is not null").withColumn("__a", F.coalesce(anchor, F.lit(False))).withColumn("__e", F.coalesce(expected, F.lit(False))).where("__a or __e")
    # a block of time holds the rows of its span and, as context, those of the ``width`` after it
    block = BLOCK_WIDTHS * max(width, 1)
    own = F.floor(F.col("ts") / block)
    into = F.when(F.pmod(F.col("ts"), F.lit(block)) <= width, F.array(own, own - 1)).otherwise(F.array(own))
    later = Window.partitionBy(*by, "__b").orderBy("ts").rangeBetween(0, width)
    rows = rows.withColumn("__b", F.explode(into)).withColumn("__seen", F.count_if("__e").over(later) - F.when(F.col("__e"), 1).otherwise(0)).where(F.col("__b") == own)
    return rows.where(F.col("__a") & (F.col("__seen") == 0) & (F.col("ts") + width <= covered_until)).drop("__a", "__e", "__seen", "__b")


def episodes(members: DataFrame) -> DataFrame:
    """Findings that share events, directly or over others, as one episode: finding, episode (its smallest finding).

    members: finding, event_ref.  Each event ties its findings to the smallest of them; large-star and small-star steps,
    each round cut by a checkpoint, go on until every finding hangs on the smallest of its episode, in rounds that grow with
    the logarithm of the longest chain.
    """
    from logweave.session import cut

    links = cut(members.where("finding is not null").select("finding", "event_ref").distinct())
    hubs = links.groupBy("event_ref").agg(F.min("finding").alias("low"))
    edges = cut(links.join(hubs, "event_ref").where("finding > low").select(F.col("finding").alias("high"), "low").distinct())
    while True:
        least = edges.groupBy("high").agg(F.min("low").alias("least"))
        large = edges.join(least.withColumnRenamed("high", "low"), "low", "left").select("high", F.coalesce("least", "low").alias("low")).distinct()
        # one row for each edge to the least of its neighbours: both ends of an edge go there
        ends = large.join(large.groupBy("high").agg(F.min("low").alias("least")), "high")
        ends = ends.select(F.explode(F.array("high", "low")).alias("high"), F.col("least").alias("low")).where("high > low").distinct()
        edges = cut(ends)
        twice = edges.groupBy("high").count().where("count > 1")
        if twice.isEmpty() and edges.join(edges.select(F.col("high").alias("low")), "low", "left_semi").isEmpty():
            break
    rows = links.select("finding").distinct().join(edges.withColumnRenamed("high", "finding"), "finding", "left")
    return rows.select("finding", F.coalesce("low", "finding").alias("episode"))


def entity_risk(findings: DataFrame) -> DataFrame:
    """Risk of each entity: its findings' highest level times 20, in bands. findings: entities (array), level (1 to 5)."""
    rows = findings.select(F.explode("entities").alias("entity"), "level").groupBy("entity").agg((F.max("level") * 20).alias("risk"), F.count("*").alias("findings"))
    return rows.withColumn("band", F.when(F.col("risk") >= 70, "high").when(F.col("risk") >= 40, "medium").otherwise("low"))


def rarity(df: DataFrame, columns: Sequence[str], total: int = 50, least: int = 5, top: int = 5) -> DataFrame:
    """Rare values of fields that are neither constant nor identifiers: field, value, n."""
    from logweave.operators.aggregates import unpivot

    counts = unpivot(df, columns).groupBy("field", "value").agg(F.count("*").alias("n"))
    fields = counts.groupBy("field").agg(F.sum("n").alias("all"), F.count("*").alias("values"))
    fields = fields.where((F.col("all") >= total) & (F.col("values") >= least) & (F.col("values") <= F.col("all") * 0.5))
    rows = counts.join(F.broadcast(fields), "field").where(F.col("n") <= F.greatest(F.lit(2), F.floor(F.col("all") * 0.002)))  # one row a field
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy("n", "value"))).where(F.col("rank") <= top).select("field", "value", "n", "rank")
