"""Population behaviour: signals over facts.

A fact has id, ts, ns (namespace), user, src, dst, host, action, outcome, bytes, agent, template, latency; fields that a signal needs
must be columns, the others may be missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.aggregates import percentiles
from logweave.operators.detect import beacon
from logweave.operators.joins import band_join, sized
from logweave.operators.sliding import with_sliding

HOUR = 3_600_000
DAY = 24 * HOUR


def baseline(facts: DataFrame, days: int = 7) -> DataFrame:
    """End of the learning time of each namespace: ns, cutoff."""
    return facts.groupBy("ns").agg((F.min("ts") + days * DAY).alias("cutoff"))


def new_relationship(facts: DataFrame, a: str, b: str, days: int = 7, history: int = 20) -> DataFrame:
    """Pairs first seen after the cutoff of entities with enough history before it."""
    rows = facts.join(sized(baseline(facts, days)), "ns").where(F.col(a).isNotNull() & F.col(b).isNotNull())
    known = rows.groupBy("ns", a).agg(F.count_if(F.col("ts") < F.col("cutoff")).alias("prior")).where(F.col("prior") >= history)
    pairs = rows.groupBy("ns", a, b).agg(F.min("ts").alias("first"), F.count("*").alias("n"), F.max("cutoff").alias("cutoff")).where(F.col("first") >= F.col("cutoff"))
    return pairs.join(known, ["ns", a]).select("ns", a, b, "first", "n")


def volume_change(facts: DataFrame, entity: str, size: str, least: float = 1_048_576) -> DataFrame:
    """Hours whose bytes exceed both five medians and the median plus six median deviations of the entity's hours."""
    hours = facts.where(F.col("ts").isNotNull()).groupBy("ns", entity, F.floor(F.col("ts") / HOUR).alias("hour")).agg(F.sum(size).alias("bytes"))
    hours = hours.withColumn("__k", F.concat_ws("\x1f", "ns", entity))
    med = percentiles(hours, "bytes", "__k", (0.5,)).select("__k", F.col("p50").alias("median"))
    dev = hours.join(med, "__k").withColumn("__d", F.abs(F.col("bytes") - F.col("median")))
    mad = percentiles(dev, "__d", "__k", (0.5,)).select("__k", F.col("p50").alias("mad"))
    out = dev.join(mad, "__k").where((F.col("bytes") >= least) & (F.col("bytes") > F.greatest(F.col("median") * 5, F.col("median") + F.col("mad") * 6)))
    return out.select("ns", entity, "hour", "bytes", "median", "mad")


def contextual_rarity(facts: DataFrame, entity: str, context: str, most: int = 3, history: int = 20) -> DataFrame:
    pairs = facts.where(F.col(context).isNotNull()).groupBy("ns", entity, context).agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("all", F.sum("n").over(Window.partitionBy("ns", entity)))
    return pairs.where((F.col("n") <= most) & (F.col("all") >= history))


def password_spraying(facts: DataFrame, users: int = 20, per_user: int = 5, width: int = DAY) -> DataFrame:
    """Sources that fail for many users within a day, few times each."""
    rows = with_sliding(facts.where("action = 'logon' and outcome = 'failure' and user is not null and src is not null"), ["ns", "src"], width, "user")
    hit = rows.where((F.col("win_distinct") >= users) & (F.col("win_n") <= per_user * F.col("win_distinct")))
    return hit.groupBy("ns", "src").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("win_distinct").alias("users"))


def session_context_change(facts: DataFrame, session: str, width: int = HOUR) -> DataFrame:
    """Sessions with more than one address and more than one agent within an hour."""
    rows = with_sliding(facts.where(F.col(session).isNotNull()), ["ns", session], width, "src").withColumnRenamed("win_distinct", "addresses").drop("win_n")
    rows = with_sliding(rows, ["ns", session], width, "agent").where("addresses > 1 and win_distinct > 1")
    return rows.groupBy("ns", session).agg(F.min("ts").alias("first"), F.max("addresses").alias("addresses"), F.max("win_distinct").alias("agents"))


def beaconing(facts: DataFrame) -> DataFrame:
    return beacon(facts, ["ns", "src", "dst"], 13, 1000, 0.8, 0.2, 0)


def dns_tunneling(facts: DataFrame, name: str, label: int = 24, bits: float = 3.5, queries: int = 20, names: int = 10) -> DataFrame:
    from logweave.functions.text import entropy

    first = F.substring_index(F.col(name), ".", 1)
    rows = facts.where((F.length(first) >= label) & (entropy(first) >= bits))
    parent = F.regexp_extract(F.col(name), r"([^.]+\.[^.]+)\.?$", 1).alias("parent")
    return rows.groupBy("ns", "src", parent).agg(F.count("*").alias("queries"), F.count_distinct(name).alias("names")).where((F.col("queries") >= queries) & (F.col("names") >= names))


def parse_quality(events: DataFrame) -> DataFrame:
    """Share of records without parse or time by source; repeated rows of one id count once."""
    events = events.select("id", "source", "parse_status", "ts").distinct()
    bad = F.coalesce(F.col("parse_status"), F.lit("")) != "parsed"
    return events.groupBy("source").agg(F.count("*").alias("n"), F.count_if(bad).alias("unparsed"), F.count_if(F.coalesce(F.col("ts"), F.lit(0)) == 0).alias("undated"))


def template_novelty(facts: DataFrame, days: int = 7, history: int = 20) -> DataFrame:
    return new_relationship(facts, "host", "template", days, history)


def error_change(facts: DataFrame, entity: str, least: int = 20, factor: float = 3, plus: float = 0.2) -> DataFrame:
    """Hours with an error rate of more than three times, and 0.2 above, the entity's rate in all other hours."""
    hours = facts.groupBy("ns", entity, F.floor(F.col("ts") / HOUR).alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "failure").alias("bad"))
    w = Window.partitionBy("ns", entity)
    hours = hours.withColumn("__n", F.sum("n").over(w) - F.col("n")).withColumn("__b", F.sum("bad").over(w) - F.col("bad")).where("__n > 0")
    rate, usual = F.col("bad") / F.col("n"), F.col("__b") / F.col("__n")
    return hours.where((F.col("n") >= least) & (rate > F.greatest(usual * factor, usual + plus))).select("ns", entity, "hour", "n", F.round(rate, 6).alias("rate"), F.round(usual, 6).alias("usual"))


def latency_change(facts: DataFrame, entity: str, least: int = 20, factor: float = 3) -> DataFrame:
    """Hours whose median latency is more than three times the entity's median."""
    rows = facts.where(F.col("latency").isNotNull()).withColumn("__e", F.concat_ws("\x1f", "ns", entity)).withColumn("hour", F.floor(F.col("ts") / HOUR))
    rows = rows.withColumn("__h", F.concat_ws("\x1f", "__e", F.col("hour").cast("string")))
    usual = percentiles(rows, "latency", "__e", (0.5,)).select("__e", F.col("p50").alias("usual"))
    hours = percentiles(rows, "latency", "__h", (0.5,)).where(F.col("n") >= least).withColumn("__e", F.substring_index("__h", "\x1f", 2)).withColumn("hour", F.substring_index("__h", "\x1f", -1).cast("long"))
    out = hours.join(usual, "__e").where(F.col("p50") > F.col("usual") * factor)
    return out.select(F.substring_index("__e", "\x1f", -1).alias(entity), "hour", "n", F.col("p50").alias("median"), "usual")


def authentication_chain(facts: DataFrame, failures: int = 10, width: int = HOUR // 2) -> DataFrame:
    """Successes after at least ten failures of the same user and source within half an hour."""
    rows = facts.where("action = 'logon' and user is not null and src is not null")
    rows = with_sliding(rows, ["ns", "user", "src"], width, flag=F.col("outcome") == "failure")
    return rows.where((F.col("outcome") == "success") & (F.col("win_flagged") >= failures)).select("ns", "user", "src", "ts", "id", F.col("win_flagged").alias("failures"))


def seasonal_volume(facts: DataFrame, entity: str, weeks: int = 3, factor: float = 3) -> DataFrame:
    """Hours with three times the mean of the same hour of the week, for slots with history of ``weeks`` weeks."""
    hours = facts.groupBy("ns", entity, F.floor(F.col("ts") / HOUR).alias("hour")).agg(F.count("*").alias("n")).withColumn("slot", F.pmod("hour", F.lit(168)))
    before = Window.partitionBy("ns", entity, "slot").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("seen", F.count("*").over(before)).withColumn("mean", F.avg("n").over(before))
    return hours.where((F.col("seen") >= weeks) & (F.col("n") > F.col("mean") * factor)).select("ns", entity, "hour", "n", F.round("mean", 6).alias("mean"))


def peer_volume(facts: DataFrame, entity: str, peers: int = 5, factor: float = 5) -> DataFrame:
    """Entities with five times the median volume of their namespace's entities."""
    counts = facts.groupBy("ns", entity).agg(F.count("*").alias("n"))
    base = percentiles(counts, "n", "ns", (0.5,)).where(F.col("n") >= peers).select("ns", F.col("p50").alias("median"))
    return counts.join(sized(base), "ns").where(F.col("n") > F.col("median") * factor)


def velocity(facts: DataFrame, entity: str, amount: str, unit: str, count: int, total: float, width: int = HOUR) -> DataFrame:
    """Entities whose payments of one currency in a window reach a count and a sum."""
    rows = with_sliding(facts, ["ns", entity, unit], width, number=F.col(amount))
    return rows.where((F.col("win_n") >= count) & (F.col("win_sum") >= total)).groupBy("ns", entity, unit).agg(F.min("ts").alias("first"), F.max("win_n").alias("n"), F.max("win_sum").alias("total"))


def takeover_chain(facts: DataFrame, legs: tuple[str, str, str], keys: list[str], width: int) -> DataFrame:
    """Facts of three actions one after another with the same link keys, the last within a span after the first: keys, ids and the times of both ends.

    Of each (keys, third fact) the latest second and of that the latest first fact stand in the row, so that a busy key makes no more rows
    than it has third facts.
    """
    from logweave.operators.joins import as_of_join

    names = [*keys, "ts", "id"]
    one, two, three = (facts.where(F.col("action") == leg).select(*names) for leg in legs)
    one = one.select(*keys, F.col("ts").alias("first_ts"), F.col("id").alias("first_id"), F.col("ts").alias("__t1"))
    two = two.select(*keys, (F.col("ts") - 1).alias("__t"), F.col("ts").alias("second_ts"), F.col("id").alias("second_id"))
    two = as_of_join(two, one, keys, "__t", "__t1", ["first_ts", "first_id"]).where("first_ts is not null").drop("__t")
    three = three.select(*keys, (F.col("ts") - 1).alias("__t"), F.col("ts").alias("third_ts"), F.col("id").alias("third_id"))
    two = two.withColumn("__t2", F.col("second_ts"))
    out = as_of_join(three, two, keys, "__t", "__t2", ["first_ts", "first_id", "second_ts", "second_id"]).where(F.col("third_ts") - F.col("first_ts") <= width)
    return out.select(*keys, "first_id", "second_id", "third_id", F.col("first_ts").alias("first"), F.col("third_ts").alias("last"))


def linked_pair(facts: DataFrame, first: str, second: str, keys: list[str], width: int) -> DataFrame:
    """Facts of action ``second`` within a span after ones of action ``first`` with the same link keys."""
    a = facts.where(F.col("action") == first).select(*keys, F.col("ts").alias("first_ts"), F.col("id").alias("first_id"))
    b = facts.where(F.col("action") == second).select(*keys, F.col("ts").alias("second_ts"), F.col("id").alias("second_id"))
    return band_join(a, b, keys, "first_ts", "second_ts", width)


#: Kinds of edges: both columns, the relation, and whether a fact states it, only shows both together, or lets one suppose it.
EDGES = (
    ("user", "src", "logs_on_from", "explicit"), ("user", "host", "uses", "explicit"), ("src", "dst", "talks_to", "explicit"), ("host", "template", "writes", "explicit"), ("user", "process", "runs", "explicit"),
    ("process", "parent", "started_by", "explicit"), ("host", "process", "holds", "explicit"), ("process", "file", "touches", "contextual"), ("src", "domain", "asks_for", "contextual"), ("user", "session", "has", "contextual"), ("session", "src", "may_come_from", "hypothetical"),
)


#: Packs of linked behaviour: name, first and second action, link keys, span.
PACKS = (
    ("account_then_membership", "account_create", "group_member_add", ("host",), HOUR), ("download_then_run", "file_create", "process_start", ("host",), 10 * 60_000), ("script_then_connection", "script_execution", "network_connection", ("host",), 10 * 60_000),
    ("logon_then_clear", "logon", "log_clear", ("user", "host"), HOUR), ("service_then_connection", "service_install", "network_connection", ("host",), HOUR), ("request_then_process", "http_request", "process_start", ("host",), 60_000),
)


def packs(facts: DataFrame, which=PACKS) -> DataFrame:
    """Linked pairs of all packs: pack, link, first_id, second_id, first_ts, second_ts."""
    out = None
    for name, first, second, keys, width in which:
        got = linked_pair(facts, first, second, list(keys), width)
        got = got.select(F.lit(name).alias("pack"), F.concat_ws(" / ", *keys).alias("link"), "first_id", "second_id", "first_ts", "second_ts")
        out = got if out is None else out.unionByName(got)
    return out


def graph(facts: DataFrame) -> DataFrame:
    """Temporal edges between the entities that stand in one fact: left_kind, left, relation, right_kind, right, quality, n, first, last."""
    there = [(a, b, r, q) for a, b, r, q in EDGES if a in facts.columns and b in facts.columns]
    rows = facts.select("ts", F.explode(F.array(*[F.struct(F.lit(a).alias("left_kind"), F.col(a).cast("string").alias("left"), F.lit(r).alias("relation"), F.lit(b).alias("right_kind"), F.col(b).cast("string").alias("right"), F.lit(q).alias("quality")) for a, b, r, q in there])).alias("e"))
    return rows.select("ts", "e.*").where("left is not null and right is not null").groupBy("left_kind", "left", "relation", "right_kind", "right", "quality").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
