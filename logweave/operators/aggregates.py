"""Group-by, facets, statistics, series, pivots, timelines, overview and period comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.events import EMPTY_LABEL, column_of
from logweave.functions.text import pattern_of
from logweave.functions.units import NUMBER, num_unit, unit_kind
from logweave.plans.filters import Filter, compile_filters
from logweave.session import cut

ERRORS = ("Crítico", "Erro")
GROUP_CAP = 50_000


@dataclass(frozen=True)
class Measure:
    """count, count_distinct, sum, avg, min, max or string_agg of a column."""

    kind: str
    column: str = ""
    name: str = ""

    @property
    def label(self) -> str:
        return self.name or (f"{self.kind}_{self.column}" if self.column else self.kind)


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Columns that hold an instant in epoch milliseconds: their smallest and largest values are shown as ISO texts.
INSTANTS = ("ts", "timestamp", "tempo")


def _number(df: DataFrame, column: str) -> tuple[Column, Column]:
    """(value, kind of unit) of a column: numbers are taken as they are, texts are read with their units."""
    c = column_of(df, column)
    if column in df.columns and isinstance(df.schema[column].dataType, _NUMERIC):
        return c.cast("double"), F.when(c.isNotNull(), F.lit(NUMBER))
    text = c.cast("string")
    return num_unit(text), unit_kind(text)


def dominant_unit(df: DataFrame, column: str, first: int | None = None) -> int | None:
    """The kind of unit that most of a column's values have, of all or of the ``first`` in id order that have one; of equally many the smallest."""
    _, kind = _number(df, column)
    kinds = df.select("id" if "id" in df.columns else F.lit(0).alias("id"), kind.alias("k")).where("k is not null")
    if first:
        kinds = kinds.where(F.col("k") != NUMBER).orderBy("id").limit(first)
    got = kinds.groupBy("k").count().orderBy(F.desc("count"), "k").first()
    return got["k"] if got else None


def _measure(df: DataFrame, m: Measure, unit: int | None = None) -> list[Column]:
    """A measure's columns.  unit: the kind that a group's values must all have; without one they must only be of one kind."""
    if m.kind == "count":
        return [F.count("*").alias(m.label)]
    if m.kind == "count_distinct":
        return [F.count_distinct(column_of(df, m.column).cast("string")).alias(m.label)]
    n, kind = _number(df, m.column)
    if m.column in INSTANTS and m.kind in ("min", "max"):
        value = {"min": F.min(n), "max": F.max(n)}[m.kind].cast("long")
        return [F.date_format(F.timestamp_millis(value), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(m.label)]
    value = {"sum": F.sum(n), "avg": F.avg(n), "min": F.min(n), "max": F.max(n)}[m.kind]
    mixed = (F.min(kind) != F.max(kind)) if unit is None else (F.min(kind) != unit) | (F.max(kind) != unit)
    return [F.when(mixed, None).otherwise(F.round(value, 2)).alias(m.label), F.coalesce(mixed, F.lit(False)).alias(f"{m.label}_mixed")]


def key_order(key: Column) -> list[Column]:
    """Numbers first, by value, then texts in lower case, then as written; null before all."""
    number = key.try_cast("double")
    return [F.asc_nulls_first(key.isNotNull()), F.asc(number.isNull()), F.asc(number), F.asc(F.lower(key)), F.asc(key)]


def aggregate(df: DataFrame, filters: Sequence[Filter], group: str, measures: Sequence[Measure], cap: int = GROUP_CAP, by_key: bool = False, one_unit: bool = False) -> DataFrame:
    """Measures by one column: key, measures, and for numbers whether units are mixed (then the value is null).

    The ``cap`` groups of the largest first measure, or with ``by_key`` the first in the order of keys.  With ``one_unit`` all groups must have the unit
    that most values of the measure have; the others are null and marked as mixed.  ``group_totals`` says how many groups and records there are.
    """
    rows = df.where(compile_filters(df, list(filters))).withColumn("key", column_of(df, group).cast("string"))
    units = {m: dominant_unit(rows, m.column) for m in measures if one_unit and m.column and m.kind in ("sum", "avg", "min", "max")}
    exprs = [c for m in measures if m.kind != "string_agg" for c in _measure(df, m, units.get(m))]
    out = rows.groupBy("key").agg(*exprs) if exprs else rows.select("key").distinct()
    for m in measures:
        if m.kind == "string_agg":
            joined = first_values(rows, m.column, m.label)
            out = out.join(joined.withColumnRenamed("key", "__key"), F.col("key").eqNullSafe(F.col("__key")), "left").drop("__key")
    order = key_order(F.col("key")) if by_key else [F.desc(measures[0].label), F.asc_nulls_first("key")]
    return out.orderBy(*order).limit(cap)


def explore(df: DataFrame, filters: Sequence[Filter], offset: int = 0, size: int = 50, top: int = 20) -> DataFrame:
    """One selection looked at from all sides: part (total, level, source, code, page), key, n.

    The selection is written once; the page has the ids in order of (ts, id), with the place as n.
    """
    rows = cut(df.where(compile_filters(df, list(filters))).select("id", "ts", "level", "source", "code"))
    out = rows.agg(F.count("*").alias("n")).select(F.lit("total").alias("part"), F.lit(None).cast("string").alias("key"), "n")
    for c in ("level", "source", "code"):
        counts = rows.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("key")).limit(top)
        out = out.unionByName(counts.select(F.lit(c).alias("part"), "key", "n"))
    page = rows.orderBy(F.asc_nulls_first("ts"), "id").offset(offset).limit(size).select("ts", "id")
    place = F.row_number().over(Window.orderBy(F.asc_nulls_first("ts"), "id")) + offset  # of the page's rows only
    return out.unionByName(page.select(F.lit("page").alias("part"), F.col("id").cast("string").alias("key"), place.cast("long").alias("n")))


def first_values(rows: DataFrame, column: str, label: str, most: int = 100, parts: int = 64) -> DataFrame:
    """The first non-empty values of each key in id order, joined; each of ``parts`` shares of a key's rows keeps ``most``, so that no key is one task."""
    text = column_of(rows, column).cast("string")
    some = rows.where(F.trim(text) != "").select("key", "id", text.alias("v")).withColumn("__p", F.pmod(F.xxhash64("id"), F.lit(parts)))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("key", "__p").orderBy("id"))).where(F.col("r") <= most)
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= most)
    kept = F.array_sort(F.collect_list(F.struct("r", "v")))
    text = F.array_join(F.transform(kept, lambda x: x["v"]), ", ")
    return some.groupBy("key").agg(F.concat(text, F.when(F.count("*") >= most, ", …").otherwise("")).alias(label))


def group_totals(df: DataFrame, filters: Sequence[Filter], group: str) -> DataFrame:
    """Exact numbers of groups and records, for what a cap leaves out."""
    rows = df.where(compile_filters(df, list(filters)))
    key = column_of(df, group).cast("string")
    return rows.agg((F.count_distinct(key) + F.max(key.isNull().cast("int"))).alias("groups"), F.count("*").alias("records"))


def facets(df: DataFrame, filters: Sequence[Filter], columns: Sequence[str]) -> DataFrame:
    """Counts of each column's values, each counted without the column's own filters: facet, value, n.

    One pass: a row is exploded into the columns whose other filters it passes.
    """
    entries = []
    for c in columns:
        others = compile_filters(df, [f for f in filters if f.column != c])
        value = column_of(df, c).cast("string")
        entries.append(F.when(others, F.struct(F.lit(c).alias("facet"), F.when(F.trim(F.coalesce(value, F.lit(""))) == "", EMPTY_LABEL).otherwise(value).alias("value"))))
    rows = df.select(F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("e"))
    return rows.groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))


def bounds(df: DataFrame) -> tuple[int, int] | None:
    r = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return None if r["a"] is None else (r["a"], r["b"])


def bucket_width(lo: int, hi: int, buckets: int) -> int:
    return max(1, -(-(hi - lo + 1) // buckets))


def histogram(df: DataFrame, buckets: int = 60, extra: Sequence[Column] = ()) -> DataFrame:
    """Dense time histogram: bucket, start, n and the extra measures, empty buckets included."""
    got = bounds(df)
    if got is None:
        return df.select(F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n")).limit(0)
    lo, hi = got
    w = bucket_width(lo, hi, buckets)
    counts = df.where("ts is not null").groupBy(F.floor((F.col("ts") - lo) / w).cast("int").alias("bucket")).agg(F.count("*").alias("n"), *extra)
    grid = df.sparkSession.range((hi - lo) // w + 1).select(F.col("id").cast("int").alias("bucket"), (F.lit(lo) + F.col("id") * w).alias("start"))
    return grid.join(F.broadcast(counts), "bucket", "left").na.fill(0)  # at most ``buckets`` rows on either side


def stats(df: DataFrame, filters: Sequence[Filter] = ()) -> DataFrame:
    """Level distribution with span: level, n, first, last."""
    return df.where(compile_filters(df, list(filters))).groupBy("level").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def timeline(df: DataFrame, buckets: int = 240) -> DataFrame:
    errors, warnings = F.count_if(F.col("level").isin(*ERRORS)), F.count_if(F.col("level") == "Aviso")
    return histogram(df, buckets, (errors.alias("errors"), warnings.alias("warnings")))


def top_values(df: DataFrame, column: str, n: int) -> list[str]:
    key = F.col(column).cast("string")
    got = df.where(key.isNotNull() & (F.trim(key) != "")).groupBy(key.alias("v")).count().orderBy(F.desc("count"), "v").limit(n)
    return [r["v"] for r in got.collect()]


def grouped_timeline(df: DataFrame, column: str, buckets: int = 24, top: int = 6) -> DataFrame:
    """Counts by time bucket and group: the exact ``top`` values, the others, and missing values; undated rows in bucket -1."""
    lo, hi = bounds(df) or (0, 0)
    w = bucket_width(lo, hi, buckets)
    best = top_values(df, column, top)
    key = F.col(column).cast("string")
    label = F.when(F.trim(F.coalesce(key, F.lit(""))) == "", "(missing)").when(key.isin(best), key).otherwise("(other)")
    bucket = F.coalesce(F.floor((F.col("ts") - lo) / w).cast("int"), F.lit(-1))
    return df.groupBy(bucket.alias("bucket"), label.alias("label")).agg(F.count("*").alias("n"))


def lanes(df: DataFrame, column: str, buckets: int = 60, top: int = 20) -> DataFrame:
    """Per value and bucket the events and errors of the ``top`` values, the rest as one lane."""
    lo, hi = bounds(df) or (0, 0)
    w = bucket_width(lo, hi, buckets)
    key = F.col(column).cast("string")
    best = top_values(df, column, top)
    return df.where("ts is not null").groupBy(
        F.when(key.isin(best), key).otherwise("(others)").alias("lane"), F.floor((F.col("ts") - lo) / w).cast("int").alias("bucket")
    ).agg(F.count("*").alias("n"), F.count_if(F.col("level").isin(*ERRORS)).alias("errors"))


def series(df: DataFrame, chart: str, metric: str = "count", column: str = "", split: str = "", interval_ms: int = 3_600_000, top: int = 6, terms: int = 500, most: int = 1_000_000) -> DataFrame:
    """chart=time: bucket start (dense between the first and the last), split, value; chart=terms: the top values by metric."""
    n = _number(df, column)[0] if column else F.lit(None).cast("double")
    value = {"count": F.count("*").cast("double"), "sum": F.sum(n), "avg": F.avg(n), "min": F.min(n), "max": F.max(n),
             "distinct": F.count_distinct(column_of(df, column)).cast("double")}[metric]
    value = F.round(value, 2).alias("value")
    if chart == "terms":
        return df.groupBy(column_of(df, split).cast("string").alias("term")).agg(value).orderBy(F.desc_nulls_last("value"), F.asc_nulls_first("term")).limit(terms)
    key = F.lit("") if not split else column_of(df, split).cast("string")
    if split:
        best = top_values(df, split, top)
        key = F.when(key.isin(best), key).otherwise("(other)")
    start = (F.col("ts") - F.pmod(F.col("ts"), F.lit(interval_ms))).alias("start")
    got = df.where("ts is not null").groupBy(start, key.alias("split")).agg(value)
    span = bounds(df)
    if span is None:
        return got if split else got.drop("split")
    low, high = (x - x % interval_ms for x in span)
    if (high - low) // interval_ms >= most:
        raise ValueError(f"more than {most} intervals")
    grid = df.sparkSession.range((high - low) // interval_ms + 1).select((F.lit(low) + F.col("id") * interval_ms).alias("start"))
    empty = F.coalesce("value", F.lit(0.0)) if metric in ("count", "sum", "distinct") else F.col("value")
    if not split:
        return grid.join(got.drop("split"), "start", "left").withColumn("value", empty)
    # every split that occurs, at most ``top`` and the others, in every interval
    labels = [r["split"] for r in got.select("split").distinct().collect()]
    grid = grid.withColumn("split", F.explode(F.array(*map(F.lit, labels))))
    return grid.join(got, ["start", "split"], "left").withColumn("value", empty)


def pivot(df: DataFrame, rows: Sequence[str], column: str, measures: Sequence[Measure], most_columns: int = 200) -> DataFrame:
    """Row path prefixes (no grand total unless there are no row dimensions) by column values, with a total over the columns.

    The ``most_columns`` values with the most rows have a column of their own, the others share ``(other)``.  string_agg joins the first 50 values
    in id order.
    """
    keys = [column_of(df, r).cast("string") for r in rows]
    col = column_of(df, column).cast("string")
    best = df.groupBy(col.alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("c")).limit(most_columns + 1).collect()
    if len(best) > most_columns:
        some = [r["c"] for r in best[:most_columns]]
        kept = col.isin([c for c in some if c is not None]) | (col.isNull() if None in some else F.lit(False))
        col = F.when(kept, col).otherwise("(other)")
    base = df.select(*[k.alias(f"r{i}") for i, k in enumerate(keys)], col.alias("c"), "*")
    exprs = [c for m in measures if m.kind != "string_agg" for c in _measure(df, m)] or [F.count("*").alias("__n")]
    names = [f"r{i}" for i in range(len(rows))]
    sets = [[F.col(n) for n in names[:k]] + extra for k in range(1 if names else 0, len(names) + 1) for extra in ([F.col("c")], [])]
    out = base.groupingSets(sets, *[F.col(n) for n in names], F.col("c")).agg(F.grouping_id().alias("g"), *exprs)
    depth = F.lit(0)
    for i in range(len(names)):
        depth = depth + (1 - F.col("g").bitwiseAND(1 << (len(names) - i)) / (1 << (len(names) - i))).cast("int")
    shown = F.array(*[F.coalesce(F.col(n), F.lit(EMPTY_LABEL)) for n in names]) if names else F.array().cast("array<string>")
    path = F.array_join(F.slice(shown, F.lit(1), depth), " → ") if names else F.lit("")
    label = F.when(F.col("g").bitwiseAND(1) == 1, "(total)").otherwise(F.coalesce("c", F.lit(EMPTY_LABEL)))
    out = out.select(path.alias("path"), depth.alias("depth"), label.alias("col"), *[m.label for m in measures if m.kind != "string_agg"])
    for m in measures:
        if m.kind == "string_agg":
            depths = [d for d in range(1 if names else 0, len(names) + 1)]
            places = [F.struct(F.array_join(F.slice(shown, 1, d), " → ").alias("path") if d else F.lit("").alias("path"), F.lit(d).alias("depth"), c.alias("col")) for d in depths for c in (F.lit("(total)"), F.coalesce("c", F.lit(EMPTY_LABEL)))]
            cells = base.withColumn("__p", F.explode(F.array(*places))).withColumn("key", F.to_json("__p"))
            joined = first_values(cells, m.column, m.label, 50)
            parts = F.from_json("key", "path string, depth int, col string")
            joined = joined.select(parts["path"].alias("path"), parts["depth"].alias("depth"), parts["col"].alias("col"), m.label)
            out = out.join(joined, ["path", "depth", "col"], "left")
    return out.select("path", "depth", "col", *[m.label for m in measures])


def overview_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), F.count_if(F.col("level").isin(*ERRORS)).alias("errors"), F.count_if(F.col("level") == "Aviso").alias("warnings"),
        F.count_if(F.col("ts").isNull()).alias("undated"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.count_distinct("source").alias("sources"),
    )


def overview_patterns(df: DataFrame, top: int = 80) -> DataFrame:
    p = pattern_of(F.col("message")).alias("pattern")
    return df.where("message is not null").groupBy(p).agg(F.count("*").alias("n"), F.count_if(F.col("level").isin(*ERRORS)).alias("errors")).orderBy(F.desc("n"), "pattern").limit(top)


def percentiles(df: DataFrame, column: str, by: str, ps: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles by group, exact, without sorting a group in one task.

    Values are counted, then their counts by coarse steps of about a millionth of the value: a group's steps tell in which of them
    each rank lies, and only the values of those steps are put in order.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(by, F.col(column).alias("x")).agg(F.count("*").alias("c"))
    x = F.abs(F.col("x").cast("double"))
    power = F.when(x > 0, F.floor(F.log2(x))).otherwise(0.0)
    # the place of the value between two powers of two, in 2^20 steps; equal or rising with the value, which is all that matters
    step = F.when(x > 0, (power + 1100) * (1 << 21) + F.floor(x / F.pow(F.lit(2.0), power) * (1 << 20))).otherwise(0)
    counts = counts.withColumn("__s", F.when(F.col("x") < 0, -step).otherwise(step).cast("long"))
    w = Window.partitionBy(by)
    steps = counts.groupBy(by, "__s").agg(F.sum("c").alias("c"))
    steps = steps.withColumn("__upto", F.sum("c").over(w.orderBy("__s").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    ranks = [F.ceil(F.col("n") * F.lit(p)) for p in ps]
    here = F.filter(F.array(*[F.when((r <= F.col("__upto")) & (r > F.col("__upto") - F.col("c")), F.struct(F.lit(k).alias("k"), r.alias("rank"))) for k, r in enumerate(ranks)]), lambda v: v.isNotNull())
    wanted = steps.select(by, "__s", "n", (F.col("__upto") - F.col("c")).alias("__before"), F.explode(here).alias("r"))
    found = counts.join(wanted.withColumnRenamed(by, "__wg").withColumnRenamed("__s", "__ws"), F.col(by).eqNullSafe(F.col("__wg")) & (F.col("__s") == F.col("__ws")))
    inner = F.sum("c").over(Window.partitionBy(by, "r.k").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("__rank", F.col("__before") + inner).where(F.col("__rank") >= F.col("r.rank"))
    return found.groupBy(by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("r.k") == k, F.col("x"))).alias(f"p{round(p * 100)}") for k, p in enumerate(ps)])


def compare_periods(df: DataFrame, key: Column, middle: int, top: int = 100) -> DataFrame:
    """Shares of a key before and after an instant, largest change first."""
    before, after = F.col("ts") < middle, F.col("ts") >= middle
    counts = df.where("ts is not null").groupBy(key.alias("key")).agg(F.count_if(before).alias("before"), F.count_if(after).alias("after"))
    total = df.where("ts is not null").agg(F.count_if(before).alias("b"), F.count_if(after).alias("a")).first()
    share = lambda n, t: F.coalesce(F.try_divide(F.col(n).cast("double"), F.lit(total[t])), F.lit(0.0))
    out = counts.withColumn("delta", F.round(share("after", "a") - share("before", "b"), 6))
    return out.select("key", "before", "after", "delta").orderBy(F.desc(F.abs("delta")), "key").limit(top)


def unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """id, ts, level and (field, value) of each non-empty value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = df.select("id", "ts", "level", "source", F.explode(pairs).alias("p"))
    return rows.select("id", "ts", "level", "source", "p.field", "p.value").where(F.trim(F.coalesce("value", F.lit(""))) != "")


def entity_summary(df: DataFrame, columns: Sequence[str], top: int = 20) -> DataFrame:
    """The top values of each role with counts, failures, first and last."""
    rows = unpivot(df, columns).groupBy("field", "value").agg(
        F.count("*").alias("n"), F.count_if(F.col("level").isin(*ERRORS)).alias("failures"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def field_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled and distinct values, numbers and texts of each field."""
    rows = unpivot(df, columns)
    return rows.groupBy("field").agg(
        F.count("*").alias("filled"), F.count_distinct("value").alias("distinct"), F.count_if(num_unit(F.col("value")).isNotNull()).alias("numeric"),
        F.min(F.length("value")).alias("shortest"), F.max(F.length("value")).alias("longest"),
    )
