"""Online learning in batch form: message templates, histograms, novelty and change scores."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.text import MASK, pattern_of
from logweave.operators.joins import sized
from logweave.operators.ordered import block_width, with_previous, with_running

BINS = 32


def template(message: Column, words: int = 48) -> Column:
    """The first words of a message's pattern."""
    return F.array_join(F.slice(F.split(F.trim(pattern_of(message)), r"\s+"), 1, words), " ")


def templates(df: DataFrame, context: str, most: int = 128) -> DataFrame:
    """The most frequent templates of each context, the others pooled: context, template, n, first."""
    rows = df.where("message is not null").groupBy(F.col(context).alias("context"), template(F.col("message")).alias("template")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    rank = F.row_number().over(Window.partitionBy("context").orderBy(F.desc("n"), "template"))
    rows = rows.withColumn("template", F.when(rank <= most, F.col("template")).otherwise(MASK))
    return rows.groupBy("context", "template").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def log_bin(x: Column) -> Column:
    """Bin of a positive number by its power of two."""
    return F.when(x.isNull() | (x < 0), None).otherwise(F.least(F.floor(F.log2(x + 1)).cast("int"), F.lit(BINS - 1)))


def histograms(df: DataFrame, context: str, number: str) -> DataFrame:
    return df.where(F.col(number).isNotNull()).groupBy(F.col(context).alias("context"), log_bin(F.col(number)).alias("bin")).agg(F.count("*").alias("n"))


def tail_scores(df: DataFrame, context: str, number: str) -> DataFrame:
    """Share of a context's numbers in the bins from an event's bin on: id, tail."""
    h = histograms(df, context, number)
    w = Window.partitionBy("context").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("tail", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy("context")), 6)).select("context", "bin", "tail")
    rows = df.where(F.col(number).isNotNull()).select("id", F.col(context).alias("context"), log_bin(F.col(number)).alias("bin"))
    return rows.join(h, ["context", "bin"]).select("id", "tail")


def transitions(df: DataFrame, context: str, state: str) -> DataFrame:
    """Probability of each state after another within a context: context, before, after, n, p."""
    rows = with_previous(df.select(F.col(context).alias("context"), "ts", "id", F.col(state).alias("after")), ["context"], {"after": "before"}).where("before is not null")
    counts = rows.groupBy("context", "before", "after").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("context", "before")), 6))


def wilson(bad: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share."""
    p = bad / n
    center, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (center - half) / (1 + z * z / n), (center + half) / (1 + z * z / n)


def failure_change(df: DataFrame, context: str, middle: int) -> DataFrame:
    """Contexts whose failure rate after an instant is surely above that before: the intervals don't meet."""
    bad = F.col("level").isin("Crítico", "Erro")
    c = df.where("ts is not null").groupBy(F.col(context).alias("context")).agg(
        F.count_if(F.col("ts") < middle).alias("n0"), F.count_if((F.col("ts") < middle) & bad).alias("b0"), F.count_if(F.col("ts") >= middle).alias("n1"), F.count_if((F.col("ts") >= middle) & bad).alias("b1"))
    c = c.where("n0 > 0 and n1 > 0")
    hi, lo = wilson(F.col("b0"), F.col("n0"))[1], wilson(F.col("b1"), F.col("n1"))[0]
    return c.withColumn("high_before", F.round(hi, 6)).withColumn("low_after", F.round(lo, 6)).withColumn("risen", F.col("low_after") > F.col("high_before"))


def cusum(df: DataFrame, context: str, number: str, slack: float = 0.5) -> DataFrame:
    """One-sided cumulative sums of hourly means against the context's mean: context, hour, mean, score.

    The sum's reset at zero is its distance from the lowest prefix sum so far, so that two window passes give it.
    """
    hours = df.where(F.col("ts").isNotNull() & F.col(number).isNotNull()).groupBy(F.col(context).alias("context"), F.floor(F.col("ts") / 3_600_000).alias("hour")).agg(F.avg(number).alias("mean"))
    whole = Window.partitionBy("context")
    hours = hours.withColumn("__z", (F.col("mean") - F.avg("mean").over(whole)) / F.greatest(F.stddev_pop("mean").over(whole), F.lit(1e-9)) - slack)
    order = whole.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    hours = hours.withColumn("__s", F.sum("__z").over(order))
    return hours.withColumn("score", F.round(F.col("__s") - F.least(F.lit(0.0), F.min("__s").over(order)), 4)).select("context", "hour", F.round("mean", 4).alias("mean"), "score")


def joint_novelty(df: DataFrame, context: str, a: str, b: str, rare: int = 2, common: int = 10) -> DataFrame:
    """Events in which two values meet that are common by themselves but hardly ever together: id, n (events of the pair), score.

    score: how many times rarer the pair is than if the values met by chance, in bits.  Rows with a null context or value are left out.
    """
    rows = df.where(F.col(context).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).select("id", F.col(context).alias("c"), F.col(a).alias("a"), F.col(b).alias("b"))
    pairs = rows.groupBy("c", "a", "b").agg(F.count("*").alias("n"))
    # marginals come from the pairs' counts: the events themselves aren't counted again
    pairs = pairs.withColumn("na", F.sum("n").over(Window.partitionBy("c", "a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("c", "b"))).withColumn("all", F.sum("n").over(Window.partitionBy("c")))
    odd = pairs.where((F.col("n") <= rare) & (F.col("na") >= common) & (F.col("nb") >= common))
    odd = odd.select("c", "a", "b", "n", F.round(F.log2(F.col("na").cast("double") * F.col("nb") / (F.col("all").cast("double") * F.col("n"))), 6).alias("score"))
    return rows.join(sized(odd), ["c", "a", "b"]).select("id", "n", "score")


def unexpected_failures(df: DataFrame, context: str, least: int = 20, usual: float = 0.05) -> DataFrame:
    """Failures in contexts that hardly ever fail: id, rate (of failures in the context), score (1 - rate)."""
    bad = F.col("level").isin("Crítico", "Erro")
    rates = df.groupBy(F.col(context).alias("c")).agg(F.count("*").alias("n"), F.avg(F.coalesce(bad, F.lit(False)).cast("double")).alias("rate")).where((F.col("n") >= least) & (F.col("rate") <= usual) & (F.col("rate") > 0))
    rows = df.where(bad).select("id", F.col(context).alias("c")).join(sized(rates), "c")
    return rows.select("id", F.round("rate", 6).alias("rate"), F.round(1 - F.col("rate"), 6).alias("score"))


def sequence_surprise(df: DataFrame, context: str, state: str, least: int = 10) -> DataFrame:
    """How unexpected an event is after the one before it in its context, in bits: id, before, after, surprise; states seen ``least`` times before count."""
    rows = with_previous(df.select("id", "ts", F.col(context).alias("context"), F.col(state).alias("after")), ["context"], {"after": "before"}).where("before is not null")
    counts = rows.groupBy("context", "before", "after").agg(F.count("*").alias("n"))
    counts = counts.withColumn("all", F.sum("n").over(Window.partitionBy("context", "before"))).where(F.col("all") >= least)
    counts = counts.select("context", "before", "after", F.round(-F.log2(F.col("n") / F.col("all")), 6).alias("surprise"))
    return rows.join(sized(counts), ["context", "before", "after"]).select("id", "before", "after", "surprise")


def incidents(df: DataFrame, context: str, bad: Column, gap: int = 300_000, least: int = 3) -> DataFrame:
    """Runs of bad events of a context with no more than ``gap`` between neighbours: context, first, last, n, states (different codes)."""
    rows = df.where(bad).select("id", "ts", F.col(context).alias("context"), "code")
    width = block_width(rows)
    rows = with_previous(rows, ["context"], {"ts": "__last"}, width=width)
    rows = with_running(rows, ["context"], (F.col("__last").isNull() | (F.col("ts") - F.col("__last") > gap)).cast("int"), "__run", width=width)
    out = rows.groupBy("context", "__run").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.count_distinct("code").alias("codes"))
    return out.where(F.col("n") >= least).drop("__run")


def contrasts(df: DataFrame, bad: Column, columns: Sequence[str], least: int = 20) -> DataFrame:
    """Values (hosts, versions, dependencies) whose share of bad events is surely above that of all other events: field, value, n, bad, rate, others."""
    flag = F.coalesce(bad, F.lit(False)).cast("int")
    rows = df.select(flag.alias("b"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p"))
    c = rows.where("p.value is not null").groupBy("p.field", "p.value").agg(F.count("*").alias("n"), F.sum("b").alias("bad"))
    w = Window.partitionBy("field")
    c = c.withColumn("__n", F.sum("n").over(w) - F.col("n")).withColumn("__b", F.sum("bad").over(w) - F.col("bad")).where((F.col("n") >= least) & (F.col("__n") >= least))
    low, high = wilson(F.col("bad"), F.col("n"))[0], wilson(F.col("__b"), F.col("__n"))[1]
    return c.where(low > high).select("field", "value", "n", "bad", F.round(F.col("bad") / F.col("n"), 6).alias("rate"), F.round(F.col("__b") / F.col("__n"), 6).alias("others"))


def cluster_templates(df: DataFrame, context: str, most: int = 128, words: int = 48, alike: float = 0.6) -> DataFrame:
    """Messages of a context clustered by their words: context, template (differing words masked), n, members (different patterns).

    Messages become patterns first and are counted, so that clustering sees each pattern once; patterns of one context and number of words
    are merged in order of their counts, a pattern joins the first template with ``alike`` of its words at their places, and beyond ``most`` templates
    the rest shares one.
    """
    rows = df.where("message is not null").select(F.col(context).cast("string").alias("context"), template(F.col("message"), words).alias("pattern"))
    rows = rows.groupBy("context", "pattern").agg(F.count("*").alias("n")).withColumn("size", F.size(F.split("pattern", " ")))

    def merge(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        found: list[list] = []
        for pattern, n in some.sort_values(["n", "pattern"], ascending=[False, True])[["pattern", "n"]].itertuples(index=False):
            own = pattern.split(" ")
            at = next((t for t in found if sum(a == b for a, b in zip(t[0], own)) >= alike * len(own)), None)
            if at is None and len(found) < most:
                found.append([own, int(n), 1])
            elif at is None:
                found[-1] = [[MASK] * len(own), found[-1][1] + int(n), found[-1][2] + 1]
            else:
                at[0] = [a if a == b else MASK for a, b in zip(at[0], own)]
                at[1], at[2] = at[1] + int(n), at[2] + 1
        return pd.DataFrame([(key[0], " ".join(t), n, m) for t, n, m in found], columns=["context", "template", "n", "members"])

    return rows.groupBy("context", "size").applyInPandas(merge, "context string, template string, n long, members long")


def merged_models(*models: DataFrame) -> DataFrame:
    """Transition counts of several models (context, before, after, n) as one, with the probabilities made anew."""
    out = models[0].select("context", "before", "after", "n")
    for m in models[1:]:
        out = out.unionByName(m.select("context", "before", "after", "n"))
    out = out.groupBy("context", "before", "after").agg(F.sum("n").alias("n"))
    return out.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("context", "before")), 6))
