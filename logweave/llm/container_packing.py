"""Items of varying length packed into containers of fixed capacity.

Only the histogram of lengths (at most capacity + 1 numbers) is planned with: shallow combinations of lengths that fill a
container up to a small window are enumerated, a non-negative least-squares fit against the histogram gives how often
to repeat each, the counts are rounded down to what there is, and what is left is packed greedily, largest length first.
The plan maps the k-th item of a length to a container, so that every item finds its own by its rank alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one length that one task ranks, about.
RANK_ROWS = 1_000_000
MOST_BUCKETS = 4096
#: Bits of an item's rank among those of its length; the rest of a key is the length.
SHIFT = 42


def combinations(h: np.ndarray, window: int) -> list[dict[int, int]]:
    """Shallow combinations (length: times) that fill a container up to ``window``; h[length] is how many items there are."""
    capacity = len(h) - 1
    there = np.flatnonzero(h[1:]) + 1
    out: dict[tuple, dict[int, int]] = {}

    def largest(most: int) -> int:
        k = np.searchsorted(there, most, "right") - 1
        return int(there[k]) if k >= 0 else 0

    def take(*lengths: int) -> None:
        if capacity - window <= sum(lengths) <= capacity:
            one: dict[int, int] = {}
            for x in lengths:
                if x:
                    one[x] = one.get(x, 0) + 1
            if all(h[x] >= n for x, n in one.items()):
                out.setdefault(tuple(sorted(one.items())), one)

    for a in there.tolist():
        most = capacity // a
        for times in sorted({1, 2, 3, most // 2, most - 1, most} - {0}):
            left = capacity - times * a
            if left < 0 or times > h[a]:
                continue
            b = largest(left)
            take(*[a] * times, b)
            for part in (2, 3):
                c = largest(left * (part - 1) // part)
                if c:
                    take(*[a] * times, c, largest(left - c))
    return list(out.values())


def nonnegative_least_squares(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, h: np.ndarray, count: int, steps: int = 400) -> np.ndarray:
    """x >= 0 with A x close to h, A sparse as (row, column, value); accelerated projected gradient."""

    def forward(x):
        return np.bincount(rows, values * x[columns], len(h))

    def back(r):
        return np.bincount(columns, values * r[rows], count)

    x = y = np.zeros(count)
    v = np.ones(count)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(forward(v))
        v /= max(np.linalg.norm(v), 1e-12)
    step, t = 1 / max(np.linalg.norm(back(forward(v))), 1e-12), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(forward(y) - h))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(h: np.ndarray, window: int | None = None) -> list[tuple[dict[int, int], int]]:
    """(lengths of a container, number of such containers) that take exactly the items of histogram h."""
    left, capacity = h.astype(np.int64).copy(), len(h) - 1
    left[0] = 0
    out: list[tuple[dict[int, int], int]] = []

    def apply(one: dict[int, int], times: int) -> None:
        times = min(times, *(int(left[x]) // n for x, n in one.items()))
        if times > 0:
            for x, n in one.items():
                left[x] -= n * times
            out.append((one, times))

    shapes = combinations(left, capacity // 200 if window is None else window)
    if shapes:
        parts = [(x, k, n) for k, one in enumerate(shapes) for x, n in one.items()]
        r, c, v = (np.array(p) for p in zip(*parts))
        fit = nonnegative_least_squares(r, c, v.astype(float), left.astype(float), len(shapes))
        for k in np.argsort(-fit, kind="stable"):
            if fit[k] < 1:
                break
            apply(shapes[k], int(fit[k]))
    there = (np.flatnonzero(left)).tolist()  # ascending; the rest goes in greedily
    while there:
        one, space, k = {}, capacity, len(there) - 1
        while k >= 0:
            x = there[k]
            n = min(space // x, int(left[x]))
            if n:
                one[x] = n
                space -= n * x
            k = min(k, int(np.searchsorted(there, space, "right"))) - 1
        apply(one, 1 << 62)
        there = [x for x in there if left[x]] if any(not left[x] for x in one) else there
    return out


def _slots(made: list[tuple[dict[int, int], int]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first key, container of the first key minus key) sorted by key = length, rank; number of containers."""
    used = np.zeros(capacity + 1, np.int64)
    keys, shift, base = [], [], 0
    for one, times in made:
        for x, n in one.items():
            for _ in range(n):
                keys.append(x << SHIFT | int(used[x]))
                shift.append(base - int(used[x]))
                used[x] += times
        base += times
    order = np.argsort(keys) if keys else []
    return np.array(keys, np.int64)[order], np.array(shift, np.int64)[order], base


def pack(items: DataFrame, ident: str, size: str, capacity: int) -> DataFrame:
    """One row an item or piece: the id, piece, tokens (its length) and container.

    An item is whole (piece 0) unless it alone exceeds the capacity; then all but its last piece fill a container each.
    Items of length 0 are spread over the containers; null ids and null lengths are left out; items of one id are told apart by
    their order only if the ids differ, so ids must be unique; an empty table gives no rows; further columns are ignored.
    """
    rows = items.select(F.col(ident).alias("__id"), F.col(size).cast("long").alias("__n")).where("__id is not null and __n >= 0")
    whole = F.greatest(F.ceil(F.col("__n") / capacity).cast("int"), F.lit(1))
    rows = rows.select("__id", "__n", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    rows = rows.select("__id", "piece", F.least(F.col("__n") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("int").alias("tokens"))
    h = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("tokens").count().collect():  # at most capacity + 1 rows
        h[r["tokens"]] = r["count"]
    keys, shift, containers = _slots(plan(h), capacity)
    buckets = int(min(MOST_BUCKETS, max(1, -(-int(h.max()) // RANK_ROWS))))
    rows = rows.withColumn("__b", F.pmod(F.xxhash64("__id", "piece"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("tokens", "__b").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("tokens").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("tokens", "__b", F.coalesce(before, F.lit(0)).alias("__o"))
    place = F.row_number().over(Window.partitionBy("tokens", "__b").orderBy("__id", "piece")) - 1
    rows = rows.withColumn("__r", place).join(sizes, ["tokens", "__b"]).withColumn("__r", F.col("__r") + F.col("__o"))

    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for n, rank in batches:
            length, k = n.to_numpy(np.int64), rank.to_numpy(np.int64)
            at = np.searchsorted(keys, length << SHIFT | k, "right") - 1
            found = k + shift[np.maximum(at, 0)] if len(keys) else np.zeros(len(k), np.int64)
            yield pd.Series(np.where(length == 0, k % max(containers, 1), found))

    return rows.select(F.col("__id").alias(ident), "piece", "tokens", F.pandas_udf(find, "long")("tokens", "__r").alias("container"))
