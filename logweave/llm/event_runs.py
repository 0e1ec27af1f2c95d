"""Runs of (nearly) equal consecutive events, collapsed to one row each.

Events are range-partitioned by (source, instant, id), so that one huge source spreads over many tasks.  Within a sorted
partition only the rows that differ from their predecessor are kept; the position of the next such row gives the count, the
row before it the end.  A partition's first and last run may go on in its neighbours: those rows, two a partition,
are joined once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.session import cut

_RUNS = "source string, message_key string, start_ms long, start_id long, end_ms long, lo_id long, hi_id long, events long, edge int"
#: Places of a run in its partition.
FIRST, LAST = 1, 2
_UUID = r"(?i)\{?\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b\}?"
_HEX = r"(?i)(?<![0-9a-z])(?:0x)?[0-9a-f]{8,}(?![0-9a-z])"
_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"


def near_key(message: Column) -> Column:
    """A message without numbers, UUIDs, hexadecimal identifiers of eight or more digits, letter case and white space."""
    out = F.regexp_replace(message, _UUID, "#")
    out = F.regexp_replace(out, _HEX, "#")
    out = F.regexp_replace(out, _NUMBER, "#")
    return F.lower(F.regexp_replace(out, r"(?U)\s+", ""))


def _starts(pdf: pd.DataFrame) -> np.ndarray:
    """Positions of the rows that differ from their predecessor."""
    same = np.ones(len(pdf), bool)
    for c in ("source", "message_key"):
        codes = pd.factorize(pdf[c], use_na_sentinel=False)[0]
        same[1:] &= codes[1:] == codes[:-1]
    same[0] = False
    return np.flatnonzero(~same)


def _collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: pd.DataFrame | None = None
    last, first = None, True
    for b in batches:
        repeated = b.duplicated(["source", "ms", "id"])  # repeated rows lie side by side
        if last is not None and len(b):
            same = (b["source"].iloc[0], b["ms"].iloc[0], b["id"].iloc[0]) == last
            repeated.iloc[0] |= same
            if same:
                repeated |= (b["source"] == last[0]) & (b["ms"] == last[1]) & (b["id"] == last[2])
        b = b[~repeated]
        if not len(b):
            continue
        at = _starts(b)
        ends = np.append(at[1:], len(b))
        ids = b["id"].to_numpy()
        runs = pd.DataFrame({
            "source": b["source"].to_numpy()[at], "message_key": b["message_key"].to_numpy()[at], "start_ms": b["ms"].to_numpy()[at], "start_id": ids[at],
            "end_ms": b["ms"].to_numpy()[ends - 1], "lo_id": np.minimum.reduceat(ids, at), "hi_id": np.maximum.reduceat(ids, at), "events": ends - at, "edge": 0,
        })
        last = (b["source"].iloc[-1], b["ms"].iloc[-1], b["id"].iloc[-1])
        if held is not None:
            runs = _merge(pd.concat([held, runs], ignore_index=True))
        held, runs = runs.iloc[-1:], runs.iloc[:-1].copy()
        if len(runs):
            if first:
                runs.iloc[0, runs.columns.get_loc("edge")] = FIRST
            first = False
            yield runs
    if held is not None:
        yield held.assign(edge=LAST | (FIRST if first else 0))


def _merge(runs: pd.DataFrame, at: np.ndarray | None = None) -> pd.DataFrame:
    """Neighbouring runs of one source and key, in order, become one; at: where runs begin, if that isn't at every difference."""
    at = _starts(runs) if at is None else at
    if len(at) == len(runs):
        return runs
    ends = np.append(at[1:], len(runs)) - 1
    out = runs.iloc[at].copy()
    out["end_ms"] = runs["end_ms"].to_numpy()[ends]
    for c, f in (("lo_id", np.minimum), ("hi_id", np.maximum), ("events", np.add)):
        out[c] = f.reduceat(runs[c].to_numpy(), at)
    return out


def _join_edges(runs: pd.DataFrame) -> pd.DataFrame:
    runs = runs.sort_values(["source", "start_ms", "start_id"], ignore_index=True)
    edge = runs["edge"].to_numpy()
    apart = np.ones(len(runs), bool)  # only a partition's last run goes on in the next one's first
    apart[1:] = (edge[:-1] & LAST == 0) | (edge[1:] & FIRST == 0)
    at = np.union1d(_starts(runs), np.flatnonzero(apart))
    return _merge(runs, at).assign(edge=0)


def collapse_runs(events: DataFrame, source: str, ms: str, ident: str, key: Column, least: int = 1) -> DataFrame:
    """One row a run: source, message_key, start_ms, start_id, end_ms, lo_id, hi_id, events, duration_ms.

    A run is a longest stretch of events of one source, by (ms, id), with equal ``key``.  ``least`` leaves out shorter runs.
    Events with a null source, instant or id are left out; a null key counts as empty text; repeated rows count once;
    equal instants are ordered by id; an empty table gives no rows; further columns are ignored.
    """
    rows = events.select(F.col(source).cast("string").alias("source"), F.col(ms).cast("long").alias("ms"), F.col(ident).cast("long").alias("id"),
                         F.coalesce(key, F.lit("")).alias("message_key"))
    rows = rows.where("source is not null and ms is not null and id is not null")
    ordered = rows.repartitionByRange("source", "ms", "id").sortWithinPartitions("source", "ms", "id")
    runs = cut(ordered.mapInPandas(_collapse, _RUNS).where((F.col("edge") > 0) | (F.col("events") >= least)))
    edges = runs.where("edge > 0").groupBy(F.col("edge") > 0).applyInPandas(_join_edges, _RUNS).where(F.col("events") >= least)
    out = runs.where("edge = 0").unionByName(edges).drop("edge")
    return out.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
