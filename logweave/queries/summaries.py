"""Aggregations, series, pivots, timelines and pages over the event view and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.events import EV_SQL, events_view
from logweave.functions.text import pattern_of
from logweave.operators import aggregates as A
from logweave.operators import paging as P
from logweave.plans.filters import Filter
from logweave.queries.filtering import _NUM
from logweave.tables import table

EV, NUM = f"with {EV_SQL}", f"with {EV_SQL}, {_NUM}"
M = A.Measure
Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


@query(f"{EV} select code as key, count(*) as count, count(distinct \"user\") as users, round(sum(latency), 2) as total, round(avg(latency), 2) as mean, min(latency)::double as least, "
       "max(latency)::double as most, false as total_mixed, false as mean_mixed, false as least_mixed, false as most_mixed from ev where source <> 'source-1' group by code")  # fmt: skip
def agg_group_rich(s, f):
    return A.aggregate(events_view(s, f), [Filter("source", "not_equals", "source-1")], "code",
                       [M("count"), M("count_distinct", "user", "users"), M("sum", "latency", "total"), M("avg", "latency", "mean"), M("min", "latency", "least"), M("max", "latency", "most")])


@query(f"{NUM} select source as key, count(*) as count, round(sum(n), 2) as sum_size, false as sum_size_mixed from num group by source")
def agg_units(s, f):
    return A.aggregate(events_view(s, f), [], "source", [M("count"), M("sum", "size")])


@query(f"""{EV}, m as (select *, case when id % 2 = 0 then latency || ' ms' else latency || '' end as v from ev)
    select code as key, count(*) as count, case when count(distinct id % 2) > 1 then null else sum(latency)::double end as sum_v, count(distinct id % 2) > 1 as sum_v_mixed from m group by code""")
def agg_units_mixed(s, f):
    ev = events_view(s, f).withColumn("v", F.concat(F.col("latency"), F.when(F.col("id") % 2 == 0, " ms").otherwise("")))
    return A.aggregate(ev, [], "code", [M("count"), M("sum", "v")])


@query(f"""{EV}, r as (select *, row_number() over (partition by source order by id) as rn from ev)
    select source as key, count(*) as count, string_agg(code, ', ' order by id) filter (rn <= 100) || case when count(*) >= 100 then ', …' else '' end as codes from r group by source""")
def agg_string_agg(s, f):
    return A.aggregate(events_view(s, f), [], "source", [M("count"), M("string_agg", "code", "codes")])


@query(f"{EV} select \"user\" as key, count(*) as count from ev group by 1 order by 2 desc, 1 limit 25")
def agg_top_cap(s, f):
    return A.aggregate(events_view(s, f), [], "user", [M("count")], cap=25)


@query(f"{EV} select count(distinct size) + 1 as groups, count(*) as records from ev")
def agg_omitted_totals(s, f):
    return A.group_totals(events_view(s, f), [], "size")


@query("select l_returnflag as key, count(*) as count, count(distinct cast(l_partkey as varchar)) as parts from lineitem group by 1")
def agg_lineitem(s, f):
    return A.aggregate(table(s, f, "lineitem").withColumn("id", F.col("l_orderkey")), [], "l_returnflag", [M("count"), M("count_distinct", "l_partkey", "parts")])


@query(f"""{EV} select 'code' as facet, code as value, count(*) as n from ev where level = 'Informação' group by code
    union all select 'level', level, count(*) from ev where code = 'view' group by level
    union all select 'size', coalesce(size, '(vazio)'), count(*) from ev where code = 'view' and level = 'Informação' group by 2""")
def facets_multi(s, f):
    return A.facets(events_view(s, f), [Filter("code", "equals_exact", "view"), Filter("level", "equals_exact", "Informação")], ["code", "level", "size"])


_SPAN = "select min(ts) as lo, max(ts) as hi from ev"


def _grid(n: int) -> str:
    return f"b as (select lo, hi, greatest(1, (hi - lo + {n}) // {n}) as w from ({_SPAN}))"


@query(f"{EV}, {_grid(60)}, g as (select unnest(range(0, (hi - lo) // w + 1)) as bucket, lo, w from b), c as (select (ts - lo) // w as bucket, count(*) as n from ev, b group by 1) "
       "select bucket::int as bucket, lo + bucket * w as start, coalesce(n, 0) as n from g left join c using (bucket)")  # fmt: skip
def stats_histogram(s, f):
    return A.histogram(events_view(s, f), 60)


@query(f"{EV} select level, count(*) as n, min(ts) as first, max(ts) as last from ev where k >= 50 group by level")
def stats_levels(s, f):
    return A.stats(events_view(s, f), [Filter("k", "gte", "50")])


@query(f"{EV}, {_grid(240)}, g as (select unnest(range(0, (hi - lo) // w + 1)) as bucket, lo, w from b), c as (select (ts - lo) // w as bucket, count(*) as n, count_if(level = 'Erro') as errors, "
       "count_if(level = 'Aviso') as warnings from ev, b group by 1) select bucket::int as bucket, lo + bucket * w as start, coalesce(n, 0) as n, coalesce(errors, 0) as errors, "
       "coalesce(warnings, 0) as warnings from g left join c using (bucket)")  # fmt: skip
def timeline_range(s, f):
    return A.timeline(events_view(s, f))


@query(f"{EV}, {_grid(24)}, t as (select source from ev group by source order by count(*) desc, source limit 6) select ((ts - lo) // w)::int as bucket, "
       "case when source in (select source from t) then source else '(other)' end as label, count(*) as n from ev, b group by 1, 2")  # fmt: skip
def grouped_timeline(s, f):
    return A.grouped_timeline(events_view(s, f), "source")


@query(f"{EV}, {_grid(60)}, t as (select \"user\" from ev group by 1 order by count(*) desc, 1 limit 20) select case when \"user\" in (select \"user\" from t) then \"user\" else '(others)' end as lane, "
       "((ts - lo) // w)::int as bucket, count(*) as n, count_if(level = 'Erro') as errors from ev, b group by 1, 2")  # fmt: skip
def lanes(s, f):
    return A.lanes(events_view(s, f), "user")


for _metric, _sql in {"count": "count(*)::double", "sum": "sum(latency)::double", "avg": "avg(latency)", "min": "min(latency)::double", "max": "max(latency)::double", "distinct": 'count(distinct "user")::double'}.items():
    Q[f"series_time_{_metric}"] = lambda s, f, m=_metric: A.series(events_view(s, f), "time", m, "user" if m == "distinct" else "latency")
    O[f"series_time_{_metric}"] = f"""{EV}, c as (select ts - ts % 3600000 as start, round({_sql}, 2) as value from ev group by 1), g as (select unnest(range(min(start), max(start) + 1, 3600000)) as start from c)
        select start, {'coalesce(value, 0)' if _metric in ('count', 'sum', 'distinct') else 'value'} as value from g left join c using (start)"""
    Q[f"series_terms_{_metric}"] = lambda s, f, m=_metric: A.series(events_view(s, f), "terms", m, "user" if m == "distinct" else "latency", split="source", terms=7)
    O[f"series_terms_{_metric}"] = f"{EV} select source as term, round({_sql}, 2) as value from ev group by 1 order by 2 desc, 1 limit 7"


@query(f"{EV}, t as (select code from ev group by code order by count(*) desc, code limit 3) select ts - ts % 86400000 as start, case when code in (select code from t) then code else '(other)' end as split, "
       "count(*)::double as value from ev group by 1, 2")  # fmt: skip
def series_split(s, f):
    return A.series(events_view(s, f), "time", split="code", interval_ms=86_400_000, top=3)


_STAR = "j as (select r_name, n_name, c_mktsegment, o_orderstatus, o_orderkey, o_custkey, o_totalprice from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


def _star(s, f):
    t = lambda n: table(s, f, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("id", F.col("o_orderkey"))


@query(f"""with {_STAR} select case when grouping(n_name) = 1 then r_name else r_name || ' → ' || n_name end as path, 2 - grouping(n_name) as depth,
    case when grouping(c_mktsegment) = 1 then '(total)' else c_mktsegment end as col, count(*) as count, count(distinct cast(o_custkey as varchar)) as customers
    from j group by grouping sets ((r_name, c_mktsegment), (r_name), (r_name, n_name, c_mktsegment), (r_name, n_name))""")
def pivot_rollup(s, f):
    return A.pivot(_star(s, f), ["r_name", "n_name"], "c_mktsegment", [M("count"), M("count_distinct", "o_custkey", "customers")])


@query(f"""{EV} select '' as path, 0 as depth, coalesce(code, '(total)') as col, count(*) as count, round(avg(latency), 2) as mean, max(latency)::double as most from ev group by grouping sets ((code), ())""")
def pivot_measures(s, f):
    return A.pivot(events_view(s, f), [], "code", [M("count"), M("avg", "latency", "mean"), M("max", "latency", "most")])


@query(f"{EV} select count(*) as total, count_if(level = 'Erro') as errors, count_if(level = 'Aviso') as warnings, 0 as undated, min(ts) as first, max(ts) as last, count(distinct source) as sources from ev")
def overview_totals(s, f):
    return A.overview_totals(events_view(s, f))


@query(f"{EV} select code || ' item ‹…› took ‹…› ms from ‹…›' as pattern, count(*) as n, count_if(level = 'Erro') as errors from ev group by 1")
def overview_patterns(s, f):
    return A.overview_patterns(events_view(s, f))


@query(f"{EV}, r as (select source, latency, row_number() over (partition by source order by latency) as rn, count(*) over (partition by source) as n from ev) select source, max(n) as n, "
       + ", ".join(f"min(latency) filter (rn >= ceil(n * {p})) as p{round(p * 100)}" for p in (0.5, 0.95, 0.99)) + " from r group by source")
def overview_latency(s, f):
    return A.percentiles(events_view(s, f), "latency", "source")


@query(f"""{EV}, c as (select code || ' item ‹…› took ‹…› ms from ‹…›' as key, count_if(ts < 1705276800000) as before, count_if(ts >= 1705276800000) as after from ev group by 1)
    select key, before, after, round(after / (select sum(after) from c) - before / (select sum(before) from c), 6) as delta from c""")
def compare_periods(s, f):
    return A.compare_periods(events_view(s, f), pattern_of(F.col("message")), 1705276800000)


_UNPIVOT = "u as (select id, ts, level, 'user' as field, \"user\" as value from ev union all select id, ts, level, 'ip', ip from ev union all select id, ts, level, 'size', size from ev where size is not null)"


@query(f"{EV}, {_UNPIVOT}, g as (select field, value, count(*) as n, count_if(level = 'Erro') as failures, min(ts) as first, max(ts) as last from u group by 1, 2) "
       "select *, row_number() over (partition by field order by n desc, value) as rank from g qualify rank <= 20")  # fmt: skip
def entity_summary(s, f):
    return A.entity_summary(events_view(s, f), ["user", "ip", "size"])


@query(f"{EV}, {_UNPIVOT} select field, count(*) as filled, count(distinct value) as \"distinct\", count_if(field = 'size') as numeric, min(length(value)) as shortest, max(length(value)) as longest from u group by 1")
def field_profile(s, f):
    return A.field_profile(events_view(s, f), ["user", "ip", "size"])


@query(f"{EV}, v(value) as (values ('10.0.3.56'), ('item 3 took 11 ms'), ('signup item 0')) select v.value, count(*) as n, min(ts) as first, max(ts) as last, count(distinct source) as sources "
       "from ev join v on contains(message, v.value) group by 1")  # fmt: skip
def ioc_sightings(s, f):
    ev = events_view(s, f)
    values = ["10.0.3.56", "item 3 took 11 ms", "signup item 0"]
    hit = F.filter(F.array(*map(F.lit, values)), lambda v: F.contains(F.col("message"), v))
    return ev.select("ts", "source", F.explode(hit).alias("value")).groupBy("value").agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("source").alias("sources"))


@query(f"{NUM} select id, size from num order by n is null, coalesce(n, 0), lower(coalesce(size, '')), id limit 200")
def page_sort_mixed(s, f):
    return P.page(events_view(s, f), "size", limit=200, columns=["id", "size"])


@query(f"{NUM} select id, size from num order by n is null desc, coalesce(n, 0) desc, lower(coalesce(size, '')) desc, id limit 50 offset 100")
def page_offset(s, f):
    return P.page(events_view(s, f), "size", True, 100, 50, ["id", "size"])


@query(f"{EV} select id, level from ev order by case level when 'Erro' then 2 when 'Aviso' then 3 else 4 end, id limit 100")
def page_level(s, f):
    return P.page(events_view(s, f), "level", columns=["id", "level"])


@query(f"{EV} select id, ts, code from ev where ts < 1705000000000 order by ts desc, id limit 100")
def page_keyset(s, f):
    return P.keyset_page(events_view(s, f), (1705000000000, 1 << 60), True).select("id", "ts", "code")


@query(f"{EV}, r as (select id, ts, row_number() over (order by ts, id) as rn from ev) select id, ts from r where abs(rn - (select rn from r where id = 500)) <= 10")
def trail_context(s, f):
    return P.trail(events_view(s, f), 500).select("id", "ts")


def sample_hash(s, f):
    return P.sample(events_view(s, f), 600).select("id", "code")


Q["sample_hash"] = sample_hash
O["sample_hash"] = f"{EV} select id, code from ev order by ('0x' || substr(md5(id || ':7'), 1, 15))::bigint, id limit 600"
QUERIES, ORACLE = Q, O
