"""Neighbours and running sums in the order of time, without bringing a whole key to one task.

Time is cut into blocks, several times as many as there are shuffle partitions, so that a key with very many rows spreads over as
many tasks.  A window runs within (key, block); what the blocks before give, one row a block, is carried in by a join on the same
key and block, for which the rows need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of time for each shuffle partition.
BLOCKS = 4


def block_width(df: DataFrame, ts: str = "ts", blocks: int | None = None) -> int:
    """Milliseconds of a block: the span of the rows' times cut into ``blocks``."""
    blocks = blocks or BLOCKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    return 1 if r["a"] is None else max(1, -(-(int(r["b"]) - int(r["a"]) + 1) // blocks))


def carried(rows: DataFrame, blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the columns of their block; null keys meet null keys."""
    other = blocks.select(*[F.col(k).alias(f"__carry_k{i}") for i, k in enumerate([*by, "__b"])], *[c for c in blocks.columns if c not in (*by, "__b")])
    on = F.lit(True)
    for i, k in enumerate([*by, "__b"]):
        on = on & F.col(k).eqNullSafe(F.col(f"__carry_k{i}"))
    return rows.join(other, on, "left").drop(*[f"__carry_k{i}" for i in range(len(by) + 1)])


def with_previous(df: DataFrame, by: Sequence[str], values: dict[str, str], order: Sequence[str] = ("ts", "id"), width: int | None = None) -> DataFrame:
    """``df`` with the values of the row before in the order, as new columns {column: name}; rows without time are left out.

    The first of ``order`` is the time.  Ties in the order are in no order.
    """
    ts = order[0]
    df = df.where(F.col(ts).isNotNull())
    width = width or block_width(df, ts)
    value = F.struct(*[F.col(c).alias(n) for c, n in values.items()])
    rows = df.withColumn("__b", F.floor(F.col(ts) / width)).withColumn("__v", value)
    rows = rows.withColumn("__before", F.lag("__v").over(Window.partitionBy(*by, "__b").orderBy(*order)))
    ends = rows.groupBy(*by, "__b").agg(F.max_by("__v", F.struct(*order)).alias("__end"))
    ends = ends.withColumn("__carry", F.lag("__end").over(Window.partitionBy(*by).orderBy("__b"))).drop("__end")
    out = carried(rows, ends, by)
    before = F.coalesce("__before", "__carry")
    return out.withColumns({n: before[n] for n in values.values()}).drop("__b", "__v", "__before", "__carry")


def with_running(df: DataFrame, by: Sequence[str], number: Column, name: str, order: Sequence[str] = ("ts", "id"), width: int | None = None) -> DataFrame:
    """``df`` with the sum of a number over the rows up to and with each in the order; rows without time are left out."""
    ts = order[0]
    df = df.where(F.col(ts).isNotNull())
    width = width or block_width(df, ts)
    rows = df.withColumn("__b", F.floor(F.col(ts) / width)).withColumn("__n", F.coalesce(number.cast("long"), F.lit(0)))
    w = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__within", F.sum("__n").over(w))
    sums = rows.groupBy(*by, "__b").agg(F.sum("__n").alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__carry", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    return carried(rows, sums, by).withColumn(name, F.col("__within") + F.col("__carry")).drop("__b", "__n", "__within", "__carry")
