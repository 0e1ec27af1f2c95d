"""Queries of the training-data problems tagged llm: 1, 4, 5, 7, 8, 9 and 10."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import garbled_text, stuffed_pages
from logweave.llm.container_packing import pack
from logweave.llm.event_runs import collapse_runs, near_key
from logweave.llm.heavy_hitters import frequent_items
from logweave.llm.record_copies import copies
from logweave.llm.token_ids import with_token_count, with_token_ids
from logweave.operators.stamps import epoch_to_ms
from logweave.session import cut
from logweave.tables import suffix_is, table

#: Tokens of a container.
CAPACITY = 2048
#: Share of words outside sentences from which a page counts as stuffed.
STUFFED = 0.5


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequent_items(table(spark, folder, "terms"), "v", "n", "term_id", share=(1, 200)).select("v")


def p1_top(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred largest totals, ties included."""
    return frequent_items(table(spark, folder, "terms"), "v", "n", "term_id", k=100)


def _p4_copies(spark: SparkSession, folder: str, counted: bool) -> DataFrame:
    events = table(spark, folder, "event_def").where(suffix_is(".ndjson")).select(F.lit("event_def").alias("tab"), "id", F.col("raw").alias("text"))
    keys = table(spark, folder, "normalized_event").select(F.lit("normalized_event").alias("tab"), F.col("norm_id").alias("id"), F.col("dedup_key").alias("text"))
    return copies(events.unionByName(keys), "id", "text", "tab", counted=counted).withColumnRenamed("kind", "tab")


def p4_members(spark: SparkSession, folder: str) -> DataFrame:
    """Each record with the first of its group and the number of copies."""
    return _p4_copies(spark, folder, True)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p4_copies(spark, folder, False).select("tab", "first_id", F.col("id").alias("copy_id"))


def p4_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record with its number of copies."""
    return p4_members(spark, folder).where("id = first_id").select("tab", "first_id", "copies")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "event_def").where(suffix_is(".csv", ".txt")).select("id", "raw", "message")
    texts = rows.select("id", F.expr("stack(2, 'raw', raw, 'message', message) as (field, text)")).where("text is not null")
    found = garbled_text.restored(texts, "text", garbled_text.fit(texts, "text"))
    return found.where("restored is not null").select("id", "field", "restored").dropDuplicates(["id", "field"])


def p7_runs(spark: SparkSession, folder: str, least: int = 1) -> DataFrame:
    """Every run of .jsonl events with count and duration."""
    events = table(spark, folder, "event_def").where(suffix_is(".jsonl")).select("id", "source", "message", epoch_to_ms(F.col("timestamp")).alias("ms"))
    return collapse_runs(events, "source", "ms", "id", near_key(F.col("message")), least)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_runs(spark, folder, 2).select("lo_id", "hi_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return with_token_ids(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def p9_pack(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    sizes = cut(with_token_count(texts, "text").select("doc_id", "tokens"))
    return pack(sizes, "doc_id", "tokens", CAPACITY)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    scored = stuffed_pages.with_share(pages, "text")
    return scored.where(F.col("non_prose") > STUFFED).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_top, p4_collapsed, p4_found, p4_members, p5_found, p7_found, p7_runs, p8_ids, p9_pack, p10_found)
}

_TERMS = "with d as (select distinct term_id, v, n from terms where v is not null and n is not null)"
_RUNS = r"""
with e as (
  select distinct id, source, timestamp as t, coalesce(message, '') as message from event_def
  where part_file like '%.jsonl' and timestamp is not null and timestamp <> 0 and source is not null),
k as (
  select id, source,
    case when t < 100000000000 then t * 1000 when t < 100000000000000 then t when t < 100000000000000000 then t // 1000 else t // 1000000 end as ms,
    lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message,
      '(?i)\{?\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b\}?', '#', 'g'),
      '(?i)\b(?:0x)?[0-9a-f]{8,}\b', '#', 'g'), '[0-9]+(?:[.,][0-9]+)*', '#', 'g'), '\s+', '', 'g')) as message_key
  from e),
s as (
  select *, case when message_key = lag(message_key) over (partition by source order by ms, id) then 0 else 1 end as b from k),
r as (
  select *, sum(b) over (partition by source order by ms, id) as run from s),
g as (
  select source, message_key, min(ms) as start_ms, arg_min(id, (ms, id)) as start_id, max(ms) as end_ms, min(id) as lo_id, max(id) as hi_id,
    count(*) as events, max(ms) - min(ms) as duration_ms from r group by source, message_key, run)
"""
ORACLE: dict[str, str] = {
    "p1_found": f"{_TERMS} select v from d group by v having sum(n) * 200 >= (select sum(n) from d)",
    "p1_top": f"{_TERMS} select v, sum(n)::bigint as total from d group by v qualify rank() over (order by sum(n) desc) <= 100",
    "p7_found": f"{_RUNS} select lo_id, hi_id from g where events >= 2",
    "p7_runs": f"{_RUNS} select * from g",
}
