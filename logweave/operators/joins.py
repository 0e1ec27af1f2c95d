"""Join shapes beyond the equi-join: catalog, as-of, band, range, lookup, indicators, bridges, recursion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A dimension of up to so many rows is broadcast; its size is counted first.
BROADCAST_ROWS = 100_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a table that is counted to be small, else the table as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def enrich_from_catalog(events: DataFrame, user: DataFrame, system: DataFrame) -> DataFrame:
    """Name and description by code: user's source and code, user's ``*``, system's source and code, system's ``*``."""
    out, names, texts = events, [], []
    for k, (catalog, star) in enumerate(((user, False), (user, True), (system, False), (system, True))):
        part = catalog.where((F.col("source") == "*") == F.lit(star)).select(F.col("source").alias("__s"), F.col("code").alias("__c"), F.col("name").alias(f"__n{k}"), F.col("description").alias(f"__d{k}"))
        part = part.dropDuplicates(["__s", "__c"])
        on = (F.col("code") == F.col("__c")) if star else (F.col("code") == F.col("__c")) & (F.col("source") == F.col("__s"))
        out = out.join(sized(part), on, "left").drop("__s", "__c")
        names.append(F.col(f"__n{k}"))
        texts.append(F.col(f"__d{k}"))
    out = out.withColumn("name", F.coalesce(*names)).withColumn("description", F.coalesce(*texts))
    return out.drop(*[f"__{x}{k}" for x in "nd" for k in range(4)])


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str], block: int = 86_400_000) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before it; null where there is none.

    Both sides are sorted together by (keys, block of time), so that a key with very many rows spreads over its blocks; the last
    right row before each block is carried in from a table of one row a block.  Right rows at the same instant: the one whose
    values are the greatest.
    """
    value = F.struct(*[F.col(v).alias(v) for v in values])
    a = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(value.alias("x")).schema["x"].dataType).alias("__v"))
    b = right.select(*keys, F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), value.alias("__v"))
    both = a.unionByName(b).withColumn("__b", F.floor(F.col("__t") / block))
    order = ("__t", "__side", F.asc_nulls_first("__v"))
    blocks = both.groupBy(*keys, "__b").agg(F.max_by("__v", F.when(F.col("__side") == 0, F.struct("__t", "__v"))).alias("__end"))
    carried = F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("__carry", carried).drop("__end")
    w = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").join(blocks, [*keys, "__b"], "left")
    best = F.coalesce("__last", "__carry")
    return both.select("__row.*", *[best[v].alias(v) for v in values])


def band_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_ts: str, b_ts: str, width: int, strict: bool = True) -> DataFrame:
    """Pairs of equal keys with 0 <(=) b_ts - a_ts <= width: an equi-join on keys and time bucket, with the exact range left to check.

    Columns of ``a`` and ``b`` other than the keys must differ in name.
    """
    left = a.withColumn("__b", F.floor(F.col(a_ts) / width))
    right = b.withColumn("__b", F.explode(F.array(F.floor(F.col(b_ts) / width), F.floor(F.col(b_ts) / width) - 1)))
    gap = F.col(b_ts) - F.col(a_ts)
    return left.join(right, [*keys, "__b"]).where((gap > 0 if strict else gap >= 0) & (gap <= width)).drop("__b")


def range_lookup(rows: DataFrame, number: str, ranges: DataFrame, lo: str, hi: str, values: Sequence[str]) -> DataFrame:
    """Values of the disjoint range that holds a number: the range of largest start at or before it, if it reaches so far."""
    value = F.struct(F.col(hi).alias("__hi"), *values)
    a = rows.select(F.col(number).alias("__t"), F.lit(1).alias("__side"), F.struct(*rows.columns).alias("__row"), F.lit(None).cast(ranges.select(value.alias("x")).schema["x"].dataType).alias("__v"))
    # ranges are cut at multiples of 65,536 so that rows and ranges meet in blocks of numbers
    block = 1 << 16
    b = ranges.select(F.col(lo).alias("__lo"), F.col(hi).alias("__hi0"), value.alias("__v"))
    b = b.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__lo") / block), F.floor(F.col("__hi0") / block))))
    b = b.select("__b", F.greatest(F.col("__lo"), F.col("__b") * block).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), "__v")
    a = a.withColumn("__b", F.floor(F.col("__t") / block)).select(*b.columns)
    w = Window.partitionBy("__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    inside = F.col("__last.__hi") >= F.col("__t")
    return both.select("__row.*", *[F.when(inside, F.col("__last")[v]).alias(v) for v in values])


def reference_lookup(rows: DataFrame, reference: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact lookup by composite keys; a reference with a key that stands twice is refused."""
    if not reference.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("the reference holds a key twice")
    return rows.join(sized(reference.select(*keys, *values)), list(keys), "left")


def canonical_indicator(c: Column) -> Column:
    """Addresses, domains, URLs and hashes in one writing: lower case, without scheme, port, trailing dot or slash, defanging undone."""
    text = F.lower(F.trim(c))
    text = F.regexp_replace(F.regexp_replace(text, r"\[\.\]|\(\.\)", "."), r"^hxxp", "http")
    text = F.regexp_replace(text, r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(text, r"^([^/:]+):[0-9]+(?=/|$)", "$1"), r"[./]+$", "")


def indicator_match(rows: DataFrame, column: str, indicators: DataFrame) -> DataFrame:
    """Rows whose value is an indicator (indicator, kind), by exact match of the canonical writings."""
    known = indicators.select(canonical_indicator(F.col("indicator")).alias("__i"), "indicator", "kind").dropDuplicates(["__i"])
    return rows.withColumn("__i", canonical_indicator(F.col(column))).join(sized(known), "__i").drop("__i")


def bridges(rows: DataFrame, width: int = 3_600_000, most: int | None = 64) -> DataFrame:
    """Two-hop links (a, b) -> (b, c) across sources within a time span: rows have source, ts, k1, k2.

    Middle keys that stand in more than ``most`` rows are no identifiers and link nothing (64 is the reference's rule); with
    ``most=None`` every key links.  Rows that agree in key, ends, source and time are counted before they are joined in blocks of time.
    """
    good = rows
    if most is not None:
        good = rows.join(rows.groupBy("k2").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("k2"), "k2", "left_semi")
    first = good.groupBy(F.col("k2").alias("mid"), F.col("k1").alias("from"), F.col("ts").alias("t1"), F.col("source").alias("s1")).agg(F.count("*").alias("c1"))
    second = rows.groupBy(F.col("k1").alias("mid"), F.col("k2").alias("to"), F.col("ts").alias("t2"), F.col("source").alias("s2")).agg(F.count("*").alias("c2"))
    pairs = band_join(first, second, ["mid"], "t1", "t2", width, False).where("s1 <> s2")
    return pairs.groupBy("mid", "from", "to").agg(F.sum(F.col("c1") * F.col("c2")).alias("n"), F.min("t1").alias("first"))


def ancestors(links: DataFrame, child: str, parent: str, depth: int | None = None) -> DataFrame:
    """(node, ancestor, distance) by doubling, in rounds that grow with the logarithm of the longest chain.

    Each pair comes once, with the shortest distance, so that cycles end when they have been gone around; ``depth`` leaves farther ancestors out.
    """
    from logweave.session import cut

    reach = links.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("distance"))
    reach, step = cut(reach.distinct()), 1
    while depth is None or step < depth:
        far = reach.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"), F.col("distance").alias("more"))
        longer = reach.where(F.col("distance") == step).join(far, "ancestor").select("node", F.col("further").alias("ancestor"), (F.lit(step) + F.col("more")).alias("distance"))
        longer = cut(longer.groupBy("node", "ancestor").agg(F.min("distance").alias("distance")).join(reach.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if longer.isEmpty():
            break
        reach = reach.unionByName(longer)
        step *= 2
    return reach if depth is None else reach.where(F.col("distance") <= depth)
