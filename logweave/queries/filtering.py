"""Filter chips and the search language over the event view."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.events import EV_SQL, events_view
from logweave.functions.net import ip_scope
from logweave.functions.text import entropy, iso, pattern_of, tokens
from logweave.functions.units import num_unit, unit_kind
from logweave.plans.filters import Filter, apply
from logweave.plans.language import search
from logweave.tables import table

#: Name: (filters, the same in SQL).
CHIPS = {
    "filter_contains": ([Filter("message", "contains", "ITEM 3")], "contains(lower(message), 'item 3')"),
    "filter_not_contains": ([Filter("size", "not_contains", "mb")], "coalesce(not contains(lower(size), 'mb'), true)"),
    "filter_equals": ([Filter("code", "equals", " ERROR ")], "lower(code) = 'error'"),
    "filter_not_equals": ([Filter("size", "not_equals", "0,5 KB")], "coalesce(lower(size) <> '0,5 kb', true)"),
    "filter_equals_exact": ([Filter("source", "equals_exact", "source-3")], "source = 'source-3'"),
    "filter_not_equals_exact": ([Filter("size", "not_equals_exact", "1,5 kb")], "size is null or size <> '1,5 kb'"),
    "filter_starts_with": ([Filter("user", "starts_with", "USER-1")], "starts_with(lower(\"user\"), 'user-1')"),
    "filter_regex": ([Filter("message", "regex", r"item [2-4] took \d{3} ms")], r"regexp_matches(message, 'item [2-4] took \d{3} ms')"),
    "filter_numeric_units": ([Filter("size", "gte", "100 KB")], "n >= 102400"),
    "filter_between": ([Filter("size", "between", "10 kb", "1,5 MB")], "n between 10240 and 1572864"),
    "filter_time": ([Filter("ts", "between", "2024-01-05", "2024-01-06 12:00:00")], "ts between epoch_ms(timestamp '2024-01-05') and epoch_ms(timestamp '2024-01-06 12:00:00')"),
    "filter_empty": ([Filter("size", "empty")], "trim(coalesce(size, '')) = ''"),
    "filter_not_empty": ([Filter("size", "not_empty")], "trim(coalesce(size, '')) <> ''"),
    "filter_in": ([Filter("code", "in", "Click, VIEW\nsignup")], "lower(code) in ('click', 'view', 'signup')"),
    "filter_not_in": ([Filter("size", "not_in", "0,5 kb,1,5 kb")], "coalesce(lower(trim(size)) not in ('0', '5 kb', '1'), true)"),
    "filter_in_exact": ([Filter("user", "in_exact", "user-1\nuser-20\nUser-3")], "\"user\" in ('user-1', 'user-20', 'User-3')"),
    "filter_cidr": ([Filter("ip", "cidr", "10.0.1.0/24, 10.0.4.64/27")], "a between 167772416 and 167772671 or a between 167773248 and 167773279"),
    "filter_not_cidr": ([Filter("ip", "not_cidr", "10.0.0.0/22")], "not (a between 167772160 and 167773183)"),
    "filter_term": ([Filter("message", "term", "Item took purchase")], "list_has_all(string_split_regex(lower(message), '[^a-z0-9]+'), ['item', 'took', 'purchase'])"),
    "filter_search_ci": ([Filter("message", "search", "^(VIEW|CLICK) item 5", "i")], "regexp_matches(message, '^(view|click) item 5')"),
    "filter_pattern": ([Filter("message", "pattern", "view item ‹…› took ‹…› ms from ‹…›")], "code = 'view'"),
    "filter_all_columns": ([Filter("_all", "contains", "took 99 ms"), Filter("level", "not_equals", "erro")], "contains(message, 'took 99 ms') and level <> 'Erro'"),
    "filter_query": ([Filter("", "query", "code:click AND k>90")], "code = 'click' and k > 90"),
}
#: Name: (query, the same in SQL).
SEARCHES = {
    "lang_free_text": ('"item 6 took"', "contains(message, 'item 6 took')"),
    "lang_fields_bool": ("code:error AND NOT source:source-1 OU nivel:aviso user:user-7", "(code = 'error' and source <> 'source-1') or (level = 'Aviso' and \"user\" = 'user-7')"),
    "lang_range": ("k:10..20 latency>100", "k between 10 and 20 and latency > 100"),
    "lang_brackets": ("k:[95 TO 99] -code:view", "k between 95 and 99 and code <> 'view'"),
    "lang_wildcard": ("user:user-1?0 code:*ew", "regexp_matches(\"user\", '^user-1.0$') and code like '%ew'"),
    "lang_set": ("code:(click OR view, signup) source:(source-2 source-3)", "code in ('click', 'view', 'signup') and source in ('source-2', 'source-3')"),
    "lang_not_missing": ("NOT size:*", "size is null"),
    "lang_not_below_missing": ('NOT size="12 KB"', "coalesce(size <> '12 KB', true)"),
    "lang_exact": ('code="click" user!="user-3"', "code = 'click' and \"user\" <> 'user-3'"),
    "lang_cidr": ("ip:10.0.2.0/25", "a between 167772672 and 167772799"),
    "lang_regex": (r"message:/took [0-9]{3} ms/ /^click/ ", r"regexp_matches(message, 'took [0-9]{3} ms') and code = 'click'"),
    "lang_units": ("size>=1mb", "n >= 1048576"),
    "lang_dates": ("tempo>=2024-01-20 code:purchase", "ts >= epoch_ms(timestamp '2024-01-20') and code = 'purchase'"),
    "lang_parens": ("(code:click || code:view) && !(k<50)", "code in ('click', 'view') and k >= 50"),
    "lang_level": ("nível:erro k:7", "level = 'Erro' and k = 7"),
}

_NUM = """
num as (
  select *, cast(string_split(ip, '.')[3] as bigint) * 256 + cast(string_split(ip, '.')[4] as bigint) + 167772160 as a,
    case when size like '%kb' then cast(replace(split_part(size, ' ', 1), ',', '.') as double) * 1024 when size like '%KB' then cast(split_part(size, ' ', 1) as double) * 1024
         when size like '%MB' then cast(split_part(size, ' ', 1) as double) * 1048576 end as n
  from ev)
"""
_OUT = ("id", "code", "message")


def _chip(filters):
    return lambda spark, folder: apply(events_view(spark, folder), *filters).select(*_OUT)


def _search(text):
    return lambda spark, folder: search(events_view(spark, folder), text).select(*_OUT)


def fn_text(spark, folder):
    ev = events_view(spark, folder)
    return ev.select("id", pattern_of(F.col("message")).alias("pattern"), F.size(tokens(F.col("message"))).alias("words"), iso(F.col("ts")).alias("iso"), F.round(entropy(F.col("code")), 6).alias("entropy"))


def fn_units(spark, folder):
    ev = events_view(spark, folder)
    return ev.select("id", num_unit(F.col("size")).alias("n"), unit_kind(F.col("size")).alias("kind"), ip_scope(F.col("ip")).alias("scope"))


def fn_document_tokens(spark, folder):
    """Words of all documents with their numbers of texts."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.select(F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != ""))).alias("word")).groupBy("word").agg(F.count("*").alias("texts"))


QUERIES = {k: _chip(f) for k, (f, _) in CHIPS.items()} | {k: _search(q) for k, (q, _) in SEARCHES.items()} | {f.__name__: f for f in (fn_text, fn_units, fn_document_tokens)}
ORACLE = {k: f"with {EV_SQL}, {_NUM} select {', '.join(_OUT)} from num where {sql}" for k, (_, sql) in (CHIPS | SEARCHES).items()} | {
    "fn_text": f"""with {EV_SQL} select id, code || ' item ‹…› took ‹…› ms from ‹…›' as pattern, len(string_split_regex(message, '[^a-z0-9]+')) as words,
        strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S') || case when ts % 1000 <> 0 then '.' || lpad(cast(ts % 1000 as varchar), 3, '0') else '' end || '+00:00' as iso,
        round((select -sum(c / t * log2(c / t)) from (select count(*)::double as c, sum(count(*)) over () as t from (select unnest(string_split(code, '')) as ch) group by ch)), 6) as entropy from ev""",
    "fn_units": f"with {EV_SQL}, {_NUM} select id, n, case when size is not null then 1 end as kind, 'privado' as scope from num",
    "fn_document_tokens": """select word, count(*) as texts from (select distinct doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as word from documents where text is not null)
        where word <> '' group by word""",
}
