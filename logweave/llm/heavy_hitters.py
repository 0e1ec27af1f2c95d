"""Most frequent items by exact prefix refinement.

Totals are counted by prefixes of the values' hashes.  A prefix whose total, an upper bound of each of its values' totals,
misses the bar can't hold a frequent value and is dropped; the others are told apart by longer prefixes, and at last
by the values themselves.  Each round is one scan with map-side combination: what is shuffled is at most the number of
prefixes per task, whatever the number of distinct values.  Rows that the first round retains are written once, narrow, and
the later rounds read only those.

Sums that must leave repeated rows out need every ident to meet its repeats.  They move packed: each task sorts its idents,
removes its own repeats, and sends differences of neighbours in byte planes, two to five bytes a row instead of two longs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.session import cut

#: Bits of the hash that the first round tells apart where the k largest are asked for, and its bounds for a share.
FIRST_BITS, LEAST_BITS, MOST_BITS = 16, 8, 20
#: Up to so many retained prefixes are sent to every executor; beyond, they are joined by shuffle.
BROADCAST_PREFIXES = 50_000
#: Rows that a task packs together.
PACK_ROWS = 1 << 20
#: Packs of idents for each shuffle partition.
PACKS = 4


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("__h", 64 - bits) if bits < 64 else F.col("__h")


def _keep(rows: DataFrame, kept: DataFrame, bits: int) -> DataFrame:
    """rows whose prefix is retained.

    Up to the bound the retained prefixes are fetched, once, and sent to every executor; beyond, they are joined by shuffle.
    """
    some = [(r["__p"],) for r in kept.limit(BROADCAST_PREFIXES + 1).collect()]
    if len(some) <= BROADCAST_PREFIXES:
        kept = F.broadcast(rows.sparkSession.createDataFrame(some, "__p long"))
    return rows.withColumn("__p", _prefix(bits)).join(kept, "__p", "left_semi").drop("__p")


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _distinct(*keys: np.ndarray) -> np.ndarray:
    """Places of one row of each distinct combination, in the order of the keys, the first the foremost."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order[new]


_PACKED = "pack int, v string, body binary"


def _pack(batches: Iterator[pa.RecordBatch], packs: int) -> Iterator[pa.RecordBatch]:
    def packed(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(some)
        values = t["v"].combine_chunks().dictionary_encode()
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        code = values.indices.to_numpy().astype(np.int64)
        ident, n = t["__id"].to_numpy(), t["__n"].to_numpy()
        pack = ((ident.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(packs)).astype(np.int64)
        rows = _distinct(pack, code, ident, n)
        pack, code, ident, n = pack[rows], code[rows], ident[rows], n[rows]
        at = np.flatnonzero(np.r_[True, (pack[1:] != pack[:-1]) | (code[1:] != code[:-1])])
        bodies = []
        for a, b in zip(at, [*at[1:], len(pack)]):
            steps = ident[a:b].copy()
            steps[1:] -= ident[a : b - 1]
            bodies.append(_planes(steps) + _planes(n[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(pack[at], pa.int32()), values.dictionary.take(pa.array(code[at])).cast(pa.string()), pa.array(bodies, pa.binary())], ["pack", "v", "body"])

    held, count = [], 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= PACK_ROWS:
            yield packed(held)
            held, count = [], 0
    if count:
        yield packed(held)


def _unpack(packs: pd.DataFrame) -> pd.DataFrame:
    out = []
    for v, some in packs.groupby("v", sort=False)["body"]:
        halves = [(b[: len(b) // 2], b[len(b) // 2 :]) for b in some]
        ident = np.concatenate([np.cumsum(_unplanes(a)) for a, _ in halves])
        n = np.concatenate([_unplanes(b) for _, b in halves])
        n = n[_distinct(ident, n)]
        total = (int((n >> 32).sum()) << 32) + int((n & 0xFFFFFFFF).sum())
        if not -(1 << 63) <= total < 1 << 63:
            raise OverflowError("a total exceeds 64 bits")
        out.append((v, total))
    return pd.DataFrame(out, columns=["v", "total"])


def _sums(rows: DataFrame) -> DataFrame:
    """v, total of rows (__id, v, __n) without nulls, each (ident, weight) of a value counted once."""
    packs = PACKS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.select("__id", "v", "__n").mapInArrow(lambda it: _pack(it, packs), _PACKED)
    return packed.groupBy("pack").applyInPandas(_unpack, "v string, total long")


def frequent_items(rows: DataFrame, value: str, weight: str, ident: str | None = None, share: tuple[int, int] | None = None, k: int | None = None,
                   rounds: Sequence[int] | None = None) -> DataFrame:
    """Values and their totals: v, total.  The totals are exact.

    share = (a, b): values whose weights add up to at least a/b of all weights; k: the values with the k largest totals, all that
    tie with the last one included.  Rows with a null value or weight don't count.  Rows of a value with equal ``ident`` and
    weight count once, and so do, in the sum of all weights, rows with equal ident and weight (an ident is a key; null idents count
    each for themselves), whatever the order of the rows; negative weights lower a total.  An empty table gives no rows; where the sum of
    all weights isn't positive, no value has a share.  ``rounds``: bits of the prefixes, the last 64.
    """
    if (share is None) == (k is None):
        raise ValueError("give either share or k")
    if rounds is None:  # a prefix of the first round holds about a sixteenth of the bar, so that few are retained for nothing
        first = min(MOST_BITS, max(LEAST_BITS, (16 * share[1] // max(share[0], 1)).bit_length())) if share else FIRST_BITS
        rounds = (first, 2 * first, 64)
    id_col = (F.col(ident) if ident else F.lit(None)).cast("long")
    rows = rows.select(id_col.alias("__id"), F.col(value).cast("string").alias("v"), F.col(weight).cast("long").alias("__n")).where("v is not null and __n is not null")
    rows = rows.withColumn("__h", F.xxhash64("v"))
    upper = F.sum(F.greatest(F.col("__n"), F.lit(0)))  # repeated rows and negative weights only make it larger than the total

    def totals(some: DataFrame) -> DataFrame:
        lone = some.where("__id is null").groupBy("v").agg(F.sum("__n").alias("total"))
        if ident is None:
            return lone
        return lone.unionByName(_sums(some.where("__id is not null"))).groupBy("v").agg(F.sum("total").alias("total"))

    first = rows.groupBy(_prefix(rounds[0]).alias("__p")).agg(upper.alias("__u"))
    if share is not None:
        a, b = share
        whole = totals(rows.select("__id", F.lit("").alias("v"), "__n")).first()
        if whole is None or whole["total"] <= 0:
            return rows.select("v", F.col("__n").alias("total")).limit(0)
        least = -(-whole["total"] * a // b)
    else:
        # the values of the heaviest prefixes give a lower bound of the k-th total
        heavy = first.orderBy(F.desc("__u"), "__p").limit(k).select("__p")
        bar = totals(_keep(rows, heavy, rounds[0])).orderBy(F.desc("total")).limit(k).agg(F.count("*").alias("c"), F.min("total").alias("m")).first()
        least = bar["m"] if bar["c"] == k else None
    if least is not None:
        kept = first.where(F.col("__u") >= least).select("__p")
        left = cut(_keep(rows, kept, rounds[0]))
        for bits in rounds[1:]:
            kept = left.groupBy(_prefix(bits).alias("__p")).agg(upper.alias("__u")).where(F.col("__u") >= least).select("__p")
            left = _keep(left, kept, bits)
        rows = left
    out = totals(rows)
    if least is not None:
        out = out.where(F.col("total") >= least)
    if k is not None:
        out = cut(out)
        bar = out.orderBy(F.desc("total")).limit(k).agg(F.min("total").alias("m")).first()["m"]
        out = out.where(F.col("total") >= bar) if bar is not None else out
    return out
