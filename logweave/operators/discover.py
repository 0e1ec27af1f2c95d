"""Discovery of categories, outliers, associations and shifts; journeys by identifier; operational runs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.aggregates import ERRORS, percentiles, unpivot
from logweave.operators.joins import sized
from logweave.operators.ordered import with_running


def categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of fields with 2 to 64 values that fill at most half of the rows' number: field, value, n, rare."""
    rows = unpivot(df, columns)
    counts = rows.groupBy("field", "value").agg(F.count("*").alias("n"))
    fields = counts.groupBy("field").agg(F.sum("n").alias("present"), F.count("*").alias("values"))
    fields = fields.where(F.col("values").between(2, 64) & (F.col("values") <= F.col("present") / 2))
    rare = F.col("n") <= F.greatest(F.lit(2.0), F.col("present") * 0.02)
    return counts.join(F.broadcast(fields), "field").select("field", "value", "n", rare.alias("rare"))  # fields: one row a column


def outliers(df: DataFrame, column: str, by: str) -> DataFrame:
    """Values beyond the wider of 3.5 scaled median deviations and 3 interquartile ranges of their group; groups of 20 and more."""
    some = df.where(F.col(column).isNotNull()).withColumn("__x", F.col(column).cast("double"))
    base = percentiles(some, "__x", by, (0.25, 0.5, 0.75)).where("n >= 20")
    dev = some.join(sized(base), by).withColumn("__d", F.abs(F.col("__x") - F.col("p50")))
    mad = percentiles(dev, "__d", by, (0.5,)).select(by, F.col("p50").alias("mad"))
    radius = F.greatest(F.col("mad") * 1.4826 * 3.5, (F.col("p75") - F.col("p25")) * 3)
    out = dev.join(sized(mad), by).withColumn("radius", radius)
    return out.where((F.col("radius") > 0) & (F.col("__d") > F.col("radius")))


def associations(df: DataFrame, columns: Sequence[str], count: int = 5, support: float = 0.005, lift: float = 1.5, confidence: float = 0.6, top: int = 12) -> DataFrame:
    """Pairs of values of two fields that stand together more often than by chance, strongest first.

    Pairs are counted by each two columns of one row, never by joining rows.
    """
    total = df.count()
    texts = {c: F.col(c).cast("string") for c in columns}
    pairs = [F.struct(F.lit(a).alias("fa"), texts[a].alias("va"), F.lit(b).alias("fb"), texts[b].alias("vb")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("va is not null and vb is not null").groupBy("fa", "va", "fb", "vb").agg(F.count("*").alias("n"))
    one = unpivot(df, columns).groupBy("field", "value").agg(F.count("*").alias("c"))
    out = both.where((F.col("n") >= count) & (F.col("n") >= support * total))
    out = out.join(one.select(F.col("field").alias("fa"), F.col("value").alias("va"), F.col("c").alias("ca")), ["fa", "va"])
    out = out.join(one.select(F.col("field").alias("fb"), F.col("value").alias("vb"), F.col("c").alias("cb")), ["fb", "vb"])
    out = out.withColumn("lift", F.round(F.col("n") * F.lit(float(total)) / F.col("ca") / F.col("cb"), 6))
    out = out.withColumn("confidence", F.round(F.col("n") / F.least("ca", "cb"), 6))
    out = out.where((F.col("lift") >= lift) & (F.col("confidence") >= confidence))
    return out.select("fa", "va", "fb", "vb", "n", "lift", "confidence").orderBy(F.desc(F.col("lift") * F.sqrt("n")), "fa", "va", "fb", "vb").limit(top)


def shifts(df: DataFrame, outcome: str, bins: int = 12, delta: float = 0.35, least: int = 3, baseline: int = 20) -> DataFrame:
    """Bins of time in which an outcome's share is ``delta`` above its share in the rest: bin, outcome, n, share, expected."""
    span = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    lo, width = span["a"] or 0, max(1, -(-((span["b"] or 0) - (span["a"] or 0) + 1) // bins))
    counts = df.where("ts is not null").groupBy(F.floor((F.col("ts") - lo) / width).cast("int").alias("bin"), F.col(outcome).cast("string").alias("outcome")).agg(F.count("*").alias("n"))
    by_bin, by_outcome = Window.partitionBy("bin"), Window.partitionBy("outcome")
    total = df.where("ts is not null").count()
    counts = counts.withColumn("here", F.sum("n").over(by_bin)).withColumn("all", F.sum("n").over(by_outcome))
    rest = F.lit(total) - F.col("here")
    out = counts.withColumn("share", F.round(F.col("n") / F.col("here"), 6)).withColumn("expected", F.round(F.try_divide(F.col("all") - F.col("n"), rest), 6))
    return out.where((F.col("here") >= least) & (rest >= baseline) & (F.col("share") - F.col("expected") >= delta)).select("bin", "outcome", "n", "share", "expected")


def context_shifts(df: DataFrame, fields: Sequence[str], outcomes: Sequence[str] = ("level", "code", "pattern"), bins: int = 12, top: int = 8) -> DataFrame:
    """Shifts of several outcomes over all rows and within contexts, strongest first: kind, context, outcome, expected, observed, bin, n, here, share, was, score.

    A context is a value of one of the first six fields of 2 to 12 values, or of two or three of them together; those of 24 rows
    and more count, 256 at most.  A bin of three rows, with 20 outside it, gives a shift where a value other than the usual one
    (within a context: one of 0.8 of the rest) has a share of 0.35 more than in the rest, or over all rows is a new pattern
    with a share of 0.15.  Of shifts of like outcome and value in neighbouring bins and nested contexts the strongest stays.
    """
    names = "kind string, context map<string,string>, outcome string, expected string, observed string, bin int, n long, here long, share double, was double, score double"
    timed = df.where("ts is not null")
    span = timed.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).first()
    if span["n"] < 24 or span["a"] == span["b"]:
        return df.sparkSession.createDataFrame([], names)
    width = max(1, -(-(span["b"] - span["a"] + 1) // bins))
    known = {r["field"] for r in unpivot(df, fields).groupBy("field").agg(F.count_distinct("value").alias("v"), F.count("*").alias("n")).where("v between 2 and 12 and n >= 40").collect()}
    fields = [x for x in fields if x in known][:6]
    # values of each outcome in order of number; those beyond 64 count only in totals
    ranked = unpivot(df, outcomes).where(F.trim("value") != "").groupBy("field", "value").agg(F.count("*").alias("c"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("c"), "value"))).where("rank <= 64")
    labels: dict[str, dict[str, int]] = {o: {} for o in outcomes}
    for r in ranked.collect():  # at most 64 rows an outcome
        labels[r["field"]][r["value"]] = r["rank"]
    outcomes = [o for o in outcomes if len(labels[o]) > 1]

    texts = {c: F.col(c).cast("string") for c in {*fields, *outcomes}}
    cells = timed.select(F.floor((F.col("ts") - span["a"]) / width).cast("int").alias("bin"), F.col("id"), *[F.when(F.trim(t) != "", t).alias(c) for c, t in texts.items()])
    cells = cells.groupBy("bin", *texts).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    sets = [c for k in (1, 2, 3) for c in combinations(fields, k)]
    whole = F.when(F.lit(True), F.create_map().cast("map<string,string>"))
    contexts = [whole, *[F.when(reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in c]), F.create_map(*[y for x in c for y in (F.lit(x), F.col(x))])) for c in sets]]
    cells = cells.withColumn("context", F.explode(F.filter(F.array(*contexts), lambda c: c.isNotNull()))).withColumn("key", F.to_json("context"))
    support = cells.groupBy("key").agg(F.sum("n").alias("s")).where((F.col("s") >= 24) & (F.col("key") != "{}")).orderBy(F.desc("s"), "key").limit(256)
    held = {"{}", *[r["key"] for r in support.collect()]}  # at most 257
    values = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("value")) for o in outcomes])) if outcomes else None
    if values is None:
        return df.sparkSession.createDataFrame([], names)
    counts = cells.where(F.col("key").isin(*held)).select("key", "context", "bin", "n", "id", values.alias("v")).where("v.value is not null")
    counts = counts.groupBy("key", "bin", "v.outcome", "v.value").agg(F.first("context").alias("context"), F.sum("n").alias("n"), F.min("id").alias("id"))
    kept = reduce(lambda a, b: a | b, [(F.col("outcome") == o) & F.col("value").isin(*labels[o]) for o in outcomes])
    counts = counts.groupBy("key", "bin", "outcome", F.when(kept, F.col("value")).alias("value")).agg(F.first("context").alias("context"), F.sum("n").alias("n"), F.min("id").alias("id"))

    # at most 257 contexts, 12 bins and 65 values of each outcome
    found: dict[bool, list[tuple]] = {True: [], False: []}
    tables: dict[tuple, dict[int, dict]] = {}
    context_of: dict[str, dict] = {}
    for r in counts.collect():
        context_of[r["key"]] = dict(r["context"])
        tables.setdefault((r["key"], r["outcome"]), {}).setdefault(r["bin"], {})[r["value"]] = (r["n"], r["id"])
    for (key, outcome), by_bin in tables.items():
        rank, context, every = labels[outcome], context_of[key], Counter()
        for window in by_bin.values():
            every.update({v: n for v, (n, _) in window.items()})
        total = sum(every.values())
        for b, window in by_bin.items():
            here = sum(n for n, _ in window.values())
            rest = total - here
            if rest < 20 or here < 3:
                continue
            was = {v: every[v] - window.get(v, (0, 0))[0] for v in rank}
            expected = max(rank, key=lambda v: (was[v], -rank[v]))
            usual = was[expected] / rest
            if context and usual < 0.8:
                continue
            for v, (n, first) in window.items():
                if v is None or v == expected or n < 3:
                    continue
                share, before = n / here, was[v] / rest
                new = not context and outcome == "pattern" and not was[v] and share >= 0.15
                if share - before < 0.35 and not new:
                    continue
                kind = "behavior_shift" if context else "new_pattern" if new else "distribution_shift"
                score = (share - before) * n**0.5 * (usual if context else 1.0)
                found[bool(context)].append((kind, context, outcome, expected, v, b, n, here, share, before, score, first, was[v]))
    out: list[tuple] = []
    special = {"pattern": 0, "code": 1}
    for shifts_found in found.values():
        chosen: list[tuple] = []
        for s in sorted(shifts_found, key=lambda s: (-s[10], len(s[1]), s[5], special.get(s[2], 2), s[2], s[4], sorted(s[1].items()))):
            like = (o for o in chosen if abs(o[5] - s[5]) <= 1 and (o[1].items() <= s[1].items() or s[1].items() <= o[1].items()))
            if not any((o[2], o[4]) == (s[2], s[4]) or (o[11], o[6], o[12]) == (s[11], s[6], s[12]) for o in like):
                chosen.append(s)
            if len(chosen) == top:
                break
        out += [s[:11] for s in chosen]
    return df.sparkSession.createDataFrame(out, names)


def journey_index(df: DataFrame, key: str, most_sources: int = 12, singles: bool = False) -> DataFrame:
    """Events by identifier: value, n, start, end, duration, sources, errors, warnings, missing_time."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("value"), "ts", "level", "source")
    out = rows.groupBy("value").agg(
        F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"), (F.max("ts") - F.min("ts")).alias("duration"),
        F.count_if(F.col("level").isin(*ERRORS)).alias("errors"), F.count_if(F.col("level") == "Aviso").alias("warnings"), F.count_if(F.col("ts").isNull()).alias("missing_time"),
    )
    ranked = rows.groupBy("value", "source").agg(F.count("*").alias("c")).withColumn("r", F.row_number().over(Window.partitionBy("value").orderBy(F.desc("c"), "source"))).where(F.col("r") <= most_sources)
    sources = ranked.groupBy("value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "source"))), lambda x: x["source"]), ",").alias("sources"))
    return (out if singles else out.where("n > 1")).join(sources, "value")


def journey_events(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key) == value).orderBy(F.asc_nulls_last("ts"), "id")


def journey_fields(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return unpivot(df, columns).groupBy("field").agg(F.count("*").alias("filled"), F.count_distinct("value").alias("values"))


def run_shapes(df: DataFrame, run: str, stage: str, longest: int = 1000) -> DataFrame:
    """The ordered stages of each run as one text: run, shape, first, last, stages, failed.

    Of a run beyond ``longest`` stages the shape has the first of them and a sum over the hashes of all (place, stage), so that only equal runs
    have equal shapes.
    """
    rows = with_running(df, [run], F.lit(1), "r")
    kept = rows.where(F.col("r") <= longest).groupBy(run).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(stage).alias("s")))), lambda x: x["s"]), ">").alias("shape"))
    whole = df.where("ts is not null").groupBy(run).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("stages"), F.max(F.col("level").isin(*ERRORS)).alias("failed"))
    marks = rows.groupBy(run).agg(F.when(F.count("*") > longest, F.hex(F.sum(F.xxhash64("r", stage).bitwiseAND((1 << 40) - 1)))).alias("mark"))
    kept = kept.join(marks, run).withColumn("shape", F.concat("shape", F.when(F.col("mark").isNotNull(), F.concat(F.lit(">…"), "mark")).otherwise(""))).drop("mark")
    return kept.join(whole, run)


def variants(runs: DataFrame, least: int = 5, common: float = 0.7) -> DataFrame:
    """Shapes other than the usual one, where one shape makes at least ``common`` of all runs."""
    counts = runs.groupBy("shape").agg(F.count("*").alias("n"))
    top = counts.agg(F.max(F.struct("n", "shape")).alias("t"), F.sum("n").alias("s")).first()
    if top["t"] is None or top["t"]["n"] < least or top["t"]["n"] < common * top["s"]:
        return counts.limit(0)
    return counts.where(F.col("shape") != top["t"]["shape"])


def cohort_variants(runs: DataFrame, cohort: Sequence[str], least: int = 5, common: float = 0.7) -> DataFrame:
    """Shapes other than the usual one of their cohort, where one shape makes at least ``common`` of its runs: cohort, shape, n, usual, usual_n, total."""
    counts = runs.groupBy(*cohort, "shape").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*cohort)
    first = F.first(F.struct("n", "shape")).over(w.orderBy(F.desc("n"), "shape"))
    out = counts.withColumn("__top", first).withColumn("total", F.sum("n").over(w))
    out = out.where((F.col("__top.n") >= least) & (F.col("__top.n") >= common * F.col("total")) & (F.col("shape") != F.col("__top.shape")))
    return out.select(*cohort, "shape", "n", F.col("__top.shape").alias("usual"), F.col("__top.n").alias("usual_n"), "total")


def variant_contrasts(runs: DataFrame, cohort: Sequence[str], attributes: Sequence[str], least: int = 3, top: int = 3, **rule) -> DataFrame:
    """For each variant the attribute values in whose runs it is most frequent against the cohort's other runs: cohort, shape, field, value, n, hit, other, other_hit, unknown, rank."""
    keys = [*cohort, "shape"]
    found = cohort_variants(runs, cohort, **rule).select(*keys)
    values = F.explode(F.array(*[F.struct(F.lit(a).alias("field"), F.col(a).cast("string").alias("value")) for a in attributes]))
    counts = runs.select(*keys, values.alias("v")).where("v.value is not null").groupBy(*keys, "v.field", "v.value").agg(F.count("*").alias("hit"))
    by_value, by_field, by_shape = Window.partitionBy(*cohort, "field", "value"), Window.partitionBy(*cohort, "field"), Window.partitionBy(*keys, "field")
    counts = counts.withColumn("n", F.sum("hit").over(by_value)).withColumn("known", F.sum("hit").over(by_field)).withColumn("hits", F.sum("hit").over(by_shape))
    sizes = runs.groupBy(*cohort).agg(F.count("*").alias("__all"))
    rows = counts.join(found, keys).join(sizes, list(cohort)).withColumn("other", F.col("known") - F.col("n")).withColumn("other_hit", F.col("hits") - F.col("hit"))
    rows = rows.where((F.col("n") >= least) & (F.col("other") >= least)).withColumn("unknown", F.col("__all") - F.col("known"))
    order = F.desc(F.col("hit") / F.col("n") - F.col("other_hit") / F.col("other"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "field", "value"))).where(F.col("rank") <= top).select(*keys, "field", "value", "n", "hit", "other", "other_hit", "unknown", "rank")


def long_runs(runs: DataFrame, run: str, least: int = 12) -> DataFrame:
    """Runs of at least 3 medians and 1.5 ninetieth percentiles of their shape, for shapes of ``least`` runs."""
    rows = runs.withColumn("duration", F.col("last") - F.col("first"))
    base = percentiles(rows, "duration", "shape", (0.5, 0.9)).where(F.col("n") >= least)
    return rows.join(base, "shape").where((F.col("duration") >= 3 * F.col("p50")) & (F.col("duration") > 1.5 * F.col("p90"))).select(run, "shape", "duration", "p50", "p90")


def rare_families(df: DataFrame, family: str, most: int = 3, total: int = 20) -> DataFrame:
    """Families of at most ``most`` events, critical ones or beside a family that makes half of its source."""
    counts = df.groupBy("source", family).agg(F.count("*").alias("n"), F.max(F.col("level").isin(*ERRORS)).alias("bad"))
    w = Window.partitionBy("source")
    counts = counts.withColumn("all", F.sum("n").over(w)).withColumn("top", F.max("n").over(w))
    return counts.where((F.col("n") <= most) & (F.col("all") >= total) & (F.col("bad") | (F.col("top") >= 0.5 * F.col("all")))).select("source", family, "n", "all")


def mixture(df: DataFrame, operation: str, bins: int = 12, factor: float = 1.3) -> DataFrame:
    """Failure rate of each bin against the rate its mix of operations would have had in the bins before: bin, n, rate, expected, risen."""
    span = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    lo, width = span["a"] or 0, max(1, -(-((span["b"] or 0) - (span["a"] or 0) + 1) // bins))
    c = df.where("ts is not null").groupBy(F.floor((F.col("ts") - lo) / width).cast("int").alias("bin"), F.col(operation).alias("op")).agg(F.count("*").alias("n"), F.count_if(F.col("level").isin(*ERRORS)).alias("bad"))
    w = Window.partitionBy("op").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("pn", F.sum("n").over(w)).withColumn("pbad", F.sum("bad").over(w)).where("pn > 0")
    out = c.groupBy("bin").agg(F.sum("n").alias("n"), F.round(F.sum("bad") / F.sum("n"), 6).alias("rate"), F.round(F.sum(F.col("n") * F.col("pbad") / F.col("pn")) / F.sum("n"), 6).alias("expected"))
    return out.withColumn("risen", F.col("rate") > F.col("expected") * factor)
