"""Detections, discovery, journeys, behaviour, learning, transforms, the SQL console and Sigma."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.events import EV_SQL, events_view
from logweave.functions import transforms as T
from logweave.functions.text import pattern_of
from logweave.operators import behavior as B
from logweave.operators import detect as D
from logweave.operators import discover as X
from logweave.operators import learning as L
from logweave.operators import process_tree as P
from logweave.plans import console, sigma
from logweave.plans.filters import Filter
from logweave.tables import table

EV = f"with {EV_SQL}"
Q, O = {}, {}
H = 3_600_000


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _islands(hit: str, window: str, by: str = "source") -> str:
    return f"""{EV}, h as ({window}), x as (select * from h where {hit}),
    n as (select *, case when ts - lag(ts) over (partition by {by} order by ts, id) <= {{w}} then 0 else 1 end as b from x),
    r as (select *, sum(b) over (partition by {by} order by ts, id) as run from n) select {by}, min(ts) as first, max(ts) as last, count(*) as hits, max(win_n) as peak from r group by {by}, run"""


@query(_islands("win_n >= 3", f"select *, count(*) over (partition by source order by ts range between {2 * H} preceding and current row) as win_n from ev where code = 'error'").format(w=2 * H))
def detect_threshold(s, f):
    return D.threshold(events_view(s, f), F.col("code") == "error", ["source"], 3, 2 * H)


@query(_islands("win_d >= 4", f"select *, count(*) over w as win_n, count(distinct \"user\") over w as win_d from ev where code = 'view' window w as (partition by source order by ts range between {4 * H} preceding and current row)").format(w=4 * H))
def detect_distinct(s, f):
    return D.distinct(events_view(s, f), F.col("code") == "view", ["source"], "user", 4, 4 * H)


@query(f"{EV}, h as (select id, source, count(*) over w as n, count(*) filter (code = 'error') over w as e from ev window w as (partition by source order by ts range between {6 * H} preceding and current row)) "
       "select id, n as win_n, round(e / n, 6) as ratio from h where n >= 5 and e / n >= 0.5")  # fmt: skip
def detect_ratio(s, f):
    out = D.ratio(events_view(s, f), F.col("code") == "error", F.lit(True), ["source"], 0.5, 6 * H, 5)
    return out.select("id", "win_n", F.round("ratio", 6).alias("ratio"))


@query(f"{EV}, h as (select id, sum(latency) over (partition by source order by ts range between {3 * H} preceding and current row) as s from ev where code <> 'view') select id, s as win_sum from h where s >= 500")
def detect_aggregate(s, f):
    return D.sliding_aggregate(events_view(s, f), F.col("code") != "view", ["source"], F.col("latency"), "sum", 500, 3 * H).select("id", "win_sum")


@query(f"""{EV}, g as (select "user", source, ts - lag(ts) over (partition by "user", source order by ts, id) as gap from ev), q as (select * from g where gap is not null),
    m as (select "user", source, quantile_disc(gap, 0.5) as med from q group by 1, 2)
    select q."user", q.source, count(*) + 1 as hits, max(med) as median_gap, round(avg(case when abs(gap - med) <= greatest(med * 0.5, 2000) then 1.0 else 0 end), 6) as regular
    from q join m on q."user" = m."user" and q.source = m.source group by 1, 2 having count(*) + 1 >= 6 and max(med) >= 10000 and avg(case when abs(gap - med) <= greatest(med * 0.5, 2000) then 1.0 else 0 end) >= 0.4""")
def detect_beacon(s, f):
    return D.beacon(events_view(s, f), ["user", "source"], share=0.4, spread=0.5)


@query(f"{EV}, r as (select *, row_number() over (partition by source order by ts, id) - 1 as prior, row_number() over (partition by source, \"user\" order by ts, id) as k2 from ev) "
       "select source, \"user\", ts, id, prior from r where k2 = 1 and prior >= 5")  # fmt: skip
def detect_new_value(s, f):
    return D.new_value(events_view(s, f), ["source"], "user")


_STATUS = "case code when 'error' then 404 when 'view' then 200 else 302 end"


@query(f"{EV}, s as (select *, {_STATUS} as status from ev), o as (select \"user\", min((ts, id)) as f from s where status = 200 group by 1) "
       "select s.\"user\", count(*) as misses, max(f[1]) as appeared from s join o on s.\"user\" = o.\"user\" where status = 404 and (ts, id) < f group by 1 having count(*) >= 3"
       .replace("f[1]", "struct_extract(f, 1)"))
def detect_appeared(s, f):
    ev = events_view(s, f).withColumn("status", F.when(F.col("code") == "error", 404).when(F.col("code") == "view", 200).otherwise(302))
    return D.appeared(ev, "user", "status")


@query(f"{EV}, b as (select *, latency * 1000 as bytes from ev), m as (select \"user\", quantile_disc(bytes, 0.5) as median from b group by 1 having count(*) >= 20) "
       "select id, bytes, median from b join m using (\"user\") where bytes >= median * 5 and bytes >= median + 4096")  # fmt: skip
def detect_size_outlier(s, f):
    ev = events_view(s, f).withColumn("bytes", F.col("latency") * 1000)
    return D.size_outlier(ev, "user", "bytes", 5).select("id", "bytes", "median")


@query(f"{EV}, w as (select min(ts) as a, max(ts) as b from ev) select message, count(*) as requests, count(distinct ip) as sources, min(ts) as first from ev, w group by message, a, b "
       "having count(*) >= 1 and count(distinct ip) <= 2 and avg(case when code = 'click' then 1.0 else 0 end) >= 0.5 and min(ts) >= a + 0.1 * (b - a)")  # fmt: skip
def detect_new_endpoint(s, f):
    ev = events_view(s, f).withColumn("method", F.when(F.col("code") == "click", "POST").otherwise("GET"))
    return D.new_endpoint(ev, "message", "ip", "method", requests=1)


def detect_sequence(s, f):
    return D.sequence(events_view(s, f), [F.col("code") == "signup", F.col("code") == "error", F.col("code") == "purchase"], ["user"], 12 * H)


def detect_temporal(s, f):
    return D.sequence(events_view(s, f), [F.col("code") == "signup", F.col("code") == "error", F.col("code") == "purchase"], ["user"], 12 * H, False)


for _f in (detect_sequence, detect_temporal):
    Q[_f.__name__] = _f


@query(f"{EV} select a.id, a.\"user\" from ev a where code = 'error' and ts + {6 * H} <= 1706500000000 and not exists (select 1 from ev b where b.\"user\" = a.\"user\" and b.code = 'view' and b.ts between a.ts and a.ts + {6 * H})")
def detect_absence(s, f):
    return D.absence(events_view(s, f), F.col("code") == "error", F.col("code") == "view", ["user"], 6 * H, 1706500000000).select("id", "user")


def detect_travel(s, f):
    ev = events_view(s, f).withColumn("lat", (F.col("k") % 60).cast("double")).withColumn("lon", (F.col("k") % 90).cast("double"))
    return D.travel(ev, ["user"], "lat", "lon").select("id", "user", F.round("km", 3).alias("km"))


Q["detect_travel"] = detect_travel
O["detect_travel"] = f"""{EV}, p as (select id, "user", ts, (k % 60)::double as lat, (k % 90)::double as lon, lag(ts) over w as t0, lag((k % 60)::double) over w as lat0, lag((k % 90)::double) over w as lon0 from ev window w as (partition by "user" order by ts, id)),
    d as (select *, 12742.0176 * asin(sqrt(power(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * power(sin(radians(lon - lon0) / 2), 2))) as km from p)
    select id, "user", round(km, 3) as km from d where km >= 500 and km > (ts - t0) / 3600000.0 * 1000"""


def episodes(s, f):
    """Findings (user and hour) that share sources within a day, as episodes."""
    ev = events_view(s, f).where("code = 'error'")
    members = ev.select(F.concat_ws(":", "user", F.floor(F.col("ts") / H).cast("string")).alias("finding"), F.concat_ws(":", "source", F.floor(F.col("ts") / (24 * H)).cast("string")).alias("event_ref"))
    return D.episodes(members)


Q["episodes"] = episodes
# a user has one source, so that the findings of a source and day are one episode
O["episodes"] = f"""{EV}, m as (select distinct "user" || ':' || (ts // 3600000) as finding, source || ':' || (ts // 86400000) as event_ref from ev where code = 'error') select finding, min(finding) over (partition by event_ref) as episode from m"""


@query(f"{EV}, e as (select \"user\" as entity, 1 + k % 5 as level from ev where code = 'error' union all select ip, 1 + k % 5 from ev where code = 'error') "
       "select entity, max(level) * 20 as risk, count(*) as findings, case when max(level) * 20 >= 70 then 'high' when max(level) * 20 >= 40 then 'medium' else 'low' end as band from e group by 1")  # fmt: skip
def entity_risk(s, f):
    ev = events_view(s, f).where("code = 'error'").select(F.array("user", "ip").alias("entities"), (1 + F.col("k") % 5).alias("level"))
    return D.entity_risk(ev)


@query(f"""{EV}, u as (select 'size' as field, size as value, count(*) as n from ev where size is not null group by 2 union all select 'k', cast(k as varchar), count(*) from ev group by 2),
    t as (select field, sum(n) as a, count(*) as v from u group by 1), r as (select field, value, n, row_number() over (partition by field order by n, value) as rank from u join t using (field)
    where a >= 50 and v >= 5 and v <= a * 0.5 and n <= greatest(2, floor(a * 0.002))) select * from r where rank <= 5""")
def rarity(s, f):
    return D.rarity(events_view(s, f), ["size", "k"])


@query(f"""{EV}, u as (select 'code' as field, code as value, count(*) as n from ev group by 2 union all select 'source', source, count(*) from ev group by 2 union all select 'level', level, count(*) from ev group by 2 union all select 'user', "user", count(*) from ev group by 2),
    t as (select field, sum(n) as p, count(*) as v from u group by 1) select field, value, n, n <= greatest(2.0, p * 0.02) as rare from u join t using (field) where v between 2 and 64 and v <= p / 2""")
def discover_categories(s, f):
    return X.categories(events_view(s, f), ["code", "source", "level", "user"])


@query(f"""{EV}, p as (select source, quantile_disc(latency, 0.25) as a, quantile_disc(latency, 0.5) as m, quantile_disc(latency, 0.75) as b from ev group by 1 having count(*) >= 20),
    d as (select id, ev.source, latency, abs(latency - m) as d, m, b - a as iqr from ev join p on ev.source = p.source), q as (select source, quantile_disc(d, 0.5) as mad from d group by 1)
    select id, latency from d join q on d.source = q.source where d > greatest(mad * 1.4826 * 3.5, iqr * 3)""")
def discover_outliers(s, f):
    return X.outliers(events_view(s, f), "latency", "source").select("id", "latency")


@query(f"""{EV}, p as (select 'code' as fa, code as va, 'level' as fb, level as vb, count(*) as n from ev group by 2, 4 union all select 'code', code, 'source', source, count(*) from ev group by 2, 4
    union all select 'level', level, 'source', source, count(*) from ev group by 2, 4 union all select 'user', "user", 'ip', ip, count(*) from ev group by 2, 4 union all select 'code', code, 'user', "user", count(*) from ev group by 2, 4
    union all select 'code', code, 'ip', ip, count(*) from ev group by 2, 4 union all select 'level', level, 'user', "user", count(*) from ev group by 2, 4 union all select 'level', level, 'ip', ip, count(*) from ev group by 2, 4
    union all select 'source', source, 'user', "user", count(*) from ev group by 2, 4 union all select 'source', source, 'ip', ip, count(*) from ev group by 2, 4),
    o as (select 'code' as f, code as v, count(*) as c from ev group by 2 union all select 'level', level, count(*) from ev group by 2 union all select 'source', source, count(*) from ev group by 2
    union all select 'user', "user", count(*) from ev group by 2 union all select 'ip', ip, count(*) from ev group by 2),
    z as (select fa, va, fb, vb, n, round(n * (select count(*) from ev)::double / a.c / b.c, 6) as lift, round(n / least(a.c, b.c), 6) as confidence from p join o a on a.f = fa and a.v = va join o b on b.f = fb and b.v = vb
    where n >= 5 and n >= 0.005 * (select count(*) from ev)) select * from z where lift >= 1.5 and confidence >= 0.6 order by lift * sqrt(n) desc, fa, va, fb, vb limit 12""")
def discover_associations(s, f):
    return X.associations(events_view(s, f), ["code", "level", "source", "user", "ip"])


@query(f"""{EV}, s as (select *, case when ts >= 1706000000000 and id % 3 > 0 then 'novo' else code end as c2 from ev), b as (select min(ts) as lo, greatest(1, (max(ts) - min(ts) + 12) // 12) as w, count(*) as total from s),
    c as (select ((ts - lo) // w)::int as bin, c2 as outcome, count(*) as n, max(total) as total from s, b group by 1, 2),
    w as (select *, sum(n) over (partition by bin) as here, sum(n) over (partition by outcome) as a from c)
    select bin, outcome, n, round(n / here, 6) as share, round((a - n) / (total - here), 6) as expected from w where here >= 3 and total - here >= 20 and round(n / here, 6) - round((a - n) / (total - here), 6) >= 0.35""")
def discover_shifts(s, f):
    ev = events_view(s, f).withColumn("c2", F.when((F.col("ts") >= 1706000000000) & (F.col("id") % 3 > 0), "novo").otherwise(F.col("code")))
    return X.shifts(ev, "c2")


@query(f"{EV} select code || ' item ‹…› took ‹…› ms from ‹…›' as template, count(*) as n from ev group by 1 having count(*) >= 2")
def discover_templates(s, f):
    return events_view(s, f).groupBy(pattern_of(F.col("message")).alias("template")).agg(F.count("*").alias("n")).where("n >= 2")


@query(f"""{EV}, r as (select "user" as value, source, count(*) as c from ev group by 1, 2), k as (select *, row_number() over (partition by value order by c desc, source) as r from r)
    select "user" as value, count(*) as n, min(ts) as start, max(ts) as end, max(ts) - min(ts) as duration, count_if(level = 'Erro') as errors, count_if(level = 'Aviso') as warnings, 0 as missing_time,
    (select string_agg(source, ',' order by r) from k where k.value = ev."user" and r <= 12) as sources from ev group by 1 having count(*) > 1""")
def journey_index(s, f):
    return X.journey_index(events_view(s, f), "user")


@query(f"{EV} select id, ts, code from ev where \"user\" = 'user-7'")
def journey_events(s, f):
    return X.journey_events(events_view(s, f), "user", "user-7").select("id", "ts", "code")


@query(f"{EV} select 'user' as field, count(*) as filled, count(distinct \"user\") as values from ev union all select 'size', count(size), count(distinct size) from ev")
def journey_fields(s, f):
    return X.journey_fields(events_view(s, f), ["user", "size"])


_RUNS = """runs as (select "user" || ':' || (ts // 43200000) as run, string_agg(code, '>' order by ts, id) as shape, min(ts) as first, max(ts) as last, count(*) as stages, bool_or(level = 'Erro') as failed from ev group by 1)"""


def _runs(s, f):
    ev = events_view(s, f).withColumn("run", F.concat_ws(":", "user", F.floor(F.col("ts") / 43_200_000).cast("string")))
    return X.run_shapes(ev, "run", "code")


def discover_context_shifts(s, f):
    """Shifts of level, code and message pattern, over all events and within sources and weekdays."""
    ev = events_view(s, f).withColumn("pattern", pattern_of(F.col("message"))).withColumn("weekday", F.dayofweek(F.timestamp_millis("ts")))
    return X.context_shifts(ev, ["source", "weekday"])


Q["discover_context_shifts"] = discover_context_shifts


def _source_runs(s, f):
    """The same runs with their user and source: a user has one source."""
    return _runs(s, f).withColumn("user", F.substring_index("run", ":", 1)).withColumn("source", F.concat(F.lit("source-"), F.substring_index("user", "-", -1).cast("long") % 12))


@query(f"{EV}, {_RUNS} select * from runs")
def operational_runs(s, f):
    return _runs(s, f)


@query(f"""{EV}, {_RUNS}, c as (select shape, count(*) as n from runs group by 1), t as (select shape, n from c order by n desc, shape desc limit 1)
    select c.shape, c.n from c, t where c.shape <> t.shape and t.n >= 5 and t.n >= 0.05 * (select sum(n) from c)""")
def operational_variants(s, f):
    return X.variants(_runs(s, f), 5, 0.05)


_DAYS = """runs as (select source, \"user\", string_agg(code, '>' order by ts, id) as shape from ev group by source, \"user\", ts // 43200000),
    c as (select source, shape, count(*) as n from runs group by 1, 2), t as (select *, sum(n) over (partition by source) as total, row_number() over (partition by source order by n desc, shape) as r from c)"""


@query(f"""{EV}, {_DAYS} select c.source, c.shape, c.n, t.shape as usual, t.n as usual_n, t.total::bigint as total from t join c on c.source = t.source and c.shape <> t.shape where t.r = 1 and t.n >= 5 and t.n >= 0.05 * t.total""")
def operational_cohort_variants(s, f):
    return X.cohort_variants(_source_runs(s, f), ["source"], 5, 0.05)


def operational_variant_contrasts(s, f):
    return X.variant_contrasts(_source_runs(s, f), ["source"], ["user", "failed"], least=3, common=0.05)


Q["operational_variant_contrasts"] = operational_variant_contrasts


@query(f"""{EV}, {_RUNS}, d as (select run, shape, last - first as duration from runs), p as (select shape, quantile_disc(duration, 0.5) as p50, quantile_disc(duration, 0.9) as p90 from d group by 1 having count(*) >= 12)
    select run, shape, duration, p50, p90 from d join p using (shape) where duration >= 3 * p50 and duration > 1.5 * p90""")
def operational_durations(s, f):
    return X.long_runs(_runs(s, f), "run")


@query(f"""{EV}, c as (select source, size, count(*) as n, bool_or(level = 'Erro') as bad from ev group by 1, 2), w as (select *, sum(n) over (partition by source) as a, max(n) over (partition by source) as t from c)
    select source, size, n, a as "all" from w where n <= 3 and a >= 20 and (bad or t >= 0.5 * a)""")
def operational_rare(s, f):
    return X.rare_families(events_view(s, f), "size")


@query(f"""{EV}, b as (select min(ts) as lo, greatest(1, (max(ts) - min(ts) + 12) // 12) as w from ev), c as (select ((ts - lo) // w)::int as bin, source as op, count(*) as n, count_if(level = 'Erro') as bad from ev, b group by 1, 2),
    p as (select *, sum(n) over o as pn, sum(bad) over o as pb from c window o as (partition by op order by bin rows between unbounded preceding and 1 preceding))
    select bin, sum(n) as n, round(sum(bad) / sum(n), 6) as rate, round(sum(n * pb / pn) / sum(n), 6) as expected, round(sum(bad) / sum(n), 6) > round(sum(n * pb / pn) / sum(n), 6) * 1.3 as risen from p where pn > 0 group by bin""")
def operational_mixture(s, f):
    return X.mixture(events_view(s, f), "source")


def _facts(s, f):
    e = events_view(s, f)
    return e.select("id", "ts", (F.lit("n")).alias("ns"), "user", F.col("ip").alias("src"), F.col("source").alias("dst"), F.col("source").alias("host"),
        F.when(F.col("code").isin("error", "signup"), "logon").otherwise(F.col("code")).alias("action"), F.when(F.col("code") == "error", "failure").otherwise("success").alias("outcome"),
        (F.col("latency") * 20000).alias("bytes"), F.col("code").alias("agent"), pattern_of(F.col("message")).alias("template"), "latency", F.concat(F.lit("s"), F.col("k")).alias("session"))


_FACTS = f"""{EV}, fa as (select id, ts, 'n' as ns, "user", ip as src, source as dst, source as host, case when code in ('error', 'signup') then 'logon' else code end as action,
    case when code = 'error' then 'failure' else 'success' end as outcome, latency * 20000 as bytes, code as agent, latency, 's' || k as session from ev)"""


@query(f"{_FACTS}, c as (select min(ts) + 7 * 86400000 as cutoff from fa), k as (select \"user\", count_if(ts < cutoff) as prior from fa, c group by 1), p as (select ns, \"user\", session, min(ts) as first, count(*) as n from fa group by 1, 2, 3) "
       "select p.ns, p.\"user\", p.session, first, n from p join k using (\"user\"), c where first >= cutoff and prior >= 10")  # fmt: skip
def behavior_new_relationship(s, f):
    return B.new_relationship(_facts(s, f), "user", "session", history=10)


@query(f"""{_FACTS}, h as (select ns, host, ts // 3600000 as hour, sum(bytes) as bytes from fa group by 1, 2, 3), m as (select host, quantile_disc(bytes, 0.5) as median from h group by 1),
    d as (select h.*, median, abs(bytes - median) as d from h join m using (host)), q as (select host, quantile_disc(d, 0.5) as mad from d group by 1)
    select ns, host, hour, bytes, median, mad from d join q using (host) where bytes >= 1048576 and bytes > greatest(median * 5, median + mad * 6)""")
def behavior_volume(s, f):
    return B.volume_change(_facts(s, f), "host", "bytes")


@query(f"{_FACTS}, p as (select ns, \"user\", session, count(*) as n from fa group by 1, 2, 3), a as (select *, sum(n) over (partition by ns, \"user\") as \"all\" from p) select * from a where n <= 1 and \"all\" >= 20")
def behavior_rarity(s, f):
    return B.contextual_rarity(_facts(s, f), "user", "session", 1)


@query(f"{_FACTS}, l as (select ns, ts, host as src, \"user\" from fa where action = 'logon' and outcome = 'failure'), w as (select *, count(*) over v as c, count(distinct \"user\") over v as d from l "
       "window v as (partition by ns, src order by ts range between 86400000 preceding and current row)) select ns, src, min(ts) as first, max(ts) as last, max(d) as users from w where d >= 5 and c <= 5 * d group by 1, 2")  # fmt: skip
def behavior_spraying(s, f):
    return B.password_spraying(_facts(s, f).withColumn("src", F.col("host")), users=5)


@query(f"{_FACTS}, w as (select ns, session, ts, count(distinct src) over v as a, count(distinct agent) over v as g from fa window v as (partition by ns, session order by ts range between 3600000 preceding and current row)) "
       "select ns, session, min(ts) as first, max(a) as addresses, max(g) as agents from w where a > 1 and g > 1 group by 1, 2")  # fmt: skip
def behavior_session(s, f):
    return B.session_context_change(_facts(s, f), "session")


@query(f"""{_FACTS}, h as (select ns, host, ts // 86400000 as d, ts // 3600000 as hour, outcome from fa), c as (select ns, host, hour, count(*) as n, count_if(outcome = 'failure') as b from h group by 1, 2, 3),
    w as (select *, sum(n) over (partition by host) - n as rn, sum(b) over (partition by host) - b as rb from c)
    select ns, host, hour, n, round(b / n, 6) as rate, round(rb / rn, 6) as usual from w where rn > 0 and n >= 3 and b / n > greatest(rb / rn * 3, rb / rn + 0.2)""")
def behavior_errors(s, f):
    return B.error_change(_facts(s, f), "host", 3)


@query(f"""{_FACTS}, u as (select host, quantile_disc(latency, 0.5) as usual from fa group by 1), h as (select host, ts // 3600000 as hour, count(*) as n, quantile_disc(latency, 0.5) as median from fa group by 1, 2 having count(*) >= 2)
    select host, hour, n, median, usual from h join u using (host) where median > usual * 3""")
def behavior_latency(s, f):
    return B.latency_change(_facts(s, f), "host", 2)


@query(f"{_FACTS}, w as (select *, count(*) filter (outcome = 'failure') over (partition by ns, host order by ts range between 14400000 preceding and current row) as failures from fa where action = 'logon') "
       "select ns, host as \"user\", 'x' as src, ts, id, failures from w where outcome = 'success' and failures >= 3")  # fmt: skip
def behavior_chain(s, f):
    return B.authentication_chain(_facts(s, f).withColumn("user", F.col("host")).withColumn("src", F.lit("x")), 3, 4 * H)


@query(f"""{_FACTS}, h as (select ns, host, ts // 3600000 as hour, count(*) as n from fa group by 1, 2, 3), w as (select *, count(*) over o as seen, avg(n) over o as mean from h
    window o as (partition by ns, host, hour % 168 order by hour rows between unbounded preceding and 1 preceding)) select ns, host, hour, n, round(mean, 6) as mean from w where seen >= 2 and n > mean * 1.5""")
def behavior_seasonal(s, f):
    return B.seasonal_volume(_facts(s, f), "host", 2, 1.5)


@query(f"{_FACTS}, c as (select ns, \"user\", count(*) as n from fa group by 1, 2), m as (select quantile_disc(n, 0.5) as median from c) select c.*, median from c, m where n > median * 1.2")
def behavior_peers(s, f):
    return B.peer_volume(_facts(s, f), "user", 5, 1.2)


@query(f"{_FACTS}, w as (select ns, \"user\", agent, ts, count(*) over v as c, sum(latency) over v as t from fa window v as (partition by ns, \"user\", agent order by ts range between 86400000 preceding and current row)) "
       "select ns, \"user\", agent, min(ts) as first, max(c) as n, max(t) as total from w where c >= 3 and t >= 100 group by 1, 2, 3")  # fmt: skip
def behavior_velocity(s, f):
    return B.velocity(_facts(s, f), "user", "latency", "agent", 3, 100, 24 * H)


@query(f"{_FACTS} select a.ns, a.\"user\", a.ts as first_ts, a.id as first_id, b.ts as second_ts, b.id as second_id from fa a join fa b on a.ns = b.ns and a.\"user\" = b.\"user\" where a.action = 'logon' and b.action = 'purchase' and b.ts > a.ts and b.ts - a.ts <= 300000")
def behavior_linked(s, f):
    return B.linked_pair(_facts(s, f), "logon", "purchase", ["ns", "user"], 300_000)


@query(f"""{_FACTS}, e as (select 'user' as left_kind, "user" as "left", 'logs_on_from' as relation, 'src' as right_kind, src as "right", ts from fa union all select 'user', "user", 'uses', 'host', host, ts from fa
    union all select 'src', src, 'talks_to', 'dst', dst, ts from fa union all select 'user', "user", 'has', 'session', session, ts from fa union all select 'session', session, 'may_come_from', 'src', src, ts from fa)
    select left_kind, "left", relation, right_kind, "right", case relation when 'has' then 'contextual' when 'may_come_from' then 'hypothetical' else 'explicit' end as quality, count(*) as n, min(ts) as first, max(ts) as last from e group by 1, 2, 3, 4, 5""")
def behavior_graph(s, f):
    return B.graph(_facts(s, f).drop("template"))


def behavior_quality(s, f):
    """Parse quality of event_def by source."""
    return B.parse_quality(table(s, f, "event_def").withColumnRenamed("timestamp", "ts"))


Q["behavior_quality"] = behavior_quality
O["behavior_quality"] = "select source, count(*) as n, count_if(coalesce(parse_status, '') <> 'parsed') as unparsed, count_if(coalesce(timestamp, 0) = 0) as undated from (select distinct id, source, parse_status, timestamp from event_def) group by 1"


@query(f"{EV} select source as context, code || ' item ‹…› took ‹…› ms from ‹…›' as template, count(*) as n, min(ts) as first from ev group by 1, 2")
def learn_templates(s, f):
    return L.templates(events_view(s, f), "source")


_BIN = "least(floor(log2(latency + 1)), 31)::int"


@query(f"{EV} select source as context, {_BIN} as bin, count(*) as n from ev group by 1, 2")
def learn_histograms(s, f):
    return L.histograms(events_view(s, f), "source", "latency")


@query(f"{EV}, b as (select id, source, {_BIN} as bin from ev), c as (select source, bin, count(*) as n from b group by 1, 2), t as (select source, bin, round(sum(n) over (partition by source order by bin desc) / sum(n) over (partition by source), 6) as tail from c) select id, tail from b join t using (source, bin)")
def learn_tail(s, f):
    return L.tail_scores(events_view(s, f), "source", "latency")


@query(f"{EV}, l as (select source as context, lag(code) over (partition by source order by ts, id) as before, code as after from ev), c as (select context, before, after, count(*) as n from l where before is not null group by 1, 2, 3) "
       "select *, round(n / sum(n) over (partition by context, before), 6) as p from c")  # fmt: skip
def learn_transitions(s, f):
    return L.transitions(events_view(s, f), "source", "code")


_WILSON = "(b{0} / n{0} + 1.96 * 1.96 / (2 * n{0}) {1} 1.96 * sqrt(b{0} / n{0} * (1 - b{0} / n{0}) / n{0} + 1.96 * 1.96 / (4 * n{0} * n{0}))) / (1 + 1.96 * 1.96 / n{0})"


@query(f"""{EV}, c as (select source as context, count_if(ts < 1705276800000) as n0, count_if(ts < 1705276800000 and level = 'Erro') as b0, count_if(ts >= 1705276800000) as n1, count_if(ts >= 1705276800000 and level = 'Erro') as b1 from ev group by 1)
    select *, round({_WILSON.format(0, '+')}, 6) as high_before, round({_WILSON.format(1, '-')}, 6) as low_after, round({_WILSON.format(1, '-')}, 6) > round({_WILSON.format(0, '+')}, 6) as risen from c""")
def learn_failure_change(s, f):
    return L.failure_change(events_view(s, f), "source", 1705276800000)


def learn_cusum(s, f):
    return L.cusum(events_view(s, f), "source", "latency")


Q["learn_cusum"] = learn_cusum
O["learn_cusum"] = f"""{EV}, h as (select source as context, ts // 3600000 as hour, avg(latency) as mean from ev group by 1, 2), z as (select *, (mean - avg(mean) over (partition by context)) / greatest(stddev_pop(mean) over (partition by context), 1e-9) - 0.5 as z from h),
    s as (select *, sum(z) over (partition by context order by hour rows unbounded preceding) as s from z) select context, hour, round(mean, 4) as mean, round(s - least(0, min(s) over (partition by context order by hour rows unbounded preceding)), 4) as score from s"""


@query(f"""{EV}, c as (select code, source, count(*) as n, avg(latency) as m from ev where level <> 'Aviso' group by code, source) select code, source, n, round(m, 4) as mean, rank() over (partition by code order by n desc, source) as place from c where n > 20""")
def sql_console(s, f):
    return console.execute(events_view(s, f), """with c as (select code, source, count(*) as n, avg(latency) as m from events where level <> 'Aviso' group by code, source)
        select code, source, n, round(m, 4) as mean, rank() over (partition by code order by n desc, source) as place from c where n > 20""")  # fmt: skip


@query("select doc_id, base64(encode(t)) as b64, lower(hex(encode(t))) as hx, t as back, t as hex_back, url_encode(t) as url, t as url_back from (select doc_id, coalesce(text, '') as t from documents) where t <> ''")
def transform_codecs(s, f):
    d = table(s, f, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).where("t <> ''")
    c = F.col("t")
    return d.select("doc_id", T.step(c, "base64_encode").alias("b64"), T.step(c, "hex_encode").alias("hx"), T.transform(c, ["base64url_encode", "base64url_decode"]).alias("back"),
        T.transform(c, ["hex_encode", "hex_decode"]).alias("hex_back"), T.step(c, "url_encode").alias("url"), T.transform(c, ["url_encode", "url_decode"]).alias("url_back"))


@query("select event_id, 'user ' || user_id as u, '' || (user_id % 9) as p from events")
def transform_query(s, f):
    e = table(s, f, "events")
    m = T.query_map(F.concat(F.lit("https://x.test/a?u=user+"), F.col("user_id"), F.lit("&p=1&p="), F.col("user_id") % 9, F.lit("#z")))
    return e.select("event_id", m["u"].alias("u"), m["p"].alias("p"))


@query(f"{EV} select id, code, (id % 7)::varchar as item, latency::varchar as took, ip from ev")
def transform_grok(s, f):
    ev = events_view(s, f)
    got = T.grok(F.col("message"), r"^%{WORD:code} item %{INT:item} took %{NUMBER:took} ms from %{IPV4:ip}$")
    return ev.select("id", *[c.alias(n) for n, c in got.items()])


@query(f"{EV} select id, code as what, latency || ' ms' as took, ip as rest from ev")
def transform_dissect(s, f):
    got = T.dissect(F.col("message"), "%{what} item %{?skip} took %{took} from %{rest}")
    return events_view(s, f).select("id", *[c.alias(n) for n, c in got.items()])


@query(f"{EV} select id, code as a, latency || '' as b from ev")
def transform_key_values(s, f):
    m = T.key_values(F.concat(F.lit('a="'), F.col("code"), F.lit('" x= b=0 b='), F.col("latency")))
    return events_view(s, f).select("id", m["a"].alias("a"), m["b"].alias("b"))


@query(f"{EV} select id, case when code = 'error' and k > 50 then 'falha:' || (id % 7) when latency >= 100 then 'lento' end as derived from ev")
def derived_field(s, f):
    rules = [T.Rule("message", r"item (\d+)", "falha:$1", (Filter("code", "equals", "error"), Filter("k", "gt", "50"))), T.Rule("message", r"took \d{3,} ms", "lento")]
    return T.derived_field(events_view(s, f), "derived", rules).select("id", "derived")


@query(f"{EV} select id, code || ' item ' || (id % 7) || ' took ' || latency || ' ms from ‹ip›' as masked from ev")
def export_masked(s, f):
    return events_view(s, f).select("id", T.mask_personal(F.col("message")).alias("masked"))


@query(f"{EV} select id, code from ev where (code = 'error' and (starts_with(\"user\", 'user-1') or k >= 90)) and not contains(message, 'item 3')")
def sigma_rule(s, f):
    rule = {"detection": {"sel": {"code": "error"}, "who_1": {"user|startswith": "user-1"}, "who_2": {"k|gte": 90}, "no": {"message|contains": "item 3"}, "condition": "sel and 1 of who_* and not no"}}
    return sigma.run(events_view(s, f), rule).select("id", "code")


O["sigma_count"] = O["detect_threshold"]


def sigma_count(s, f):
    return sigma.run(events_view(s, f), {"detection": {"sel": {"code": "error"}, "timeframe": "2h", "condition": "sel | count() by source >= 3"}})


def sigma_ordered(s, f):
    rules = {"a": {"detection": {"s": {"code": "signup"}, "condition": "s"}}, "b": {"detection": {"s": {"code": "error"}, "condition": "s"}}}
    return sigma.correlate(events_view(s, f), rules, {"type": "temporal_ordered", "rules": ["a", "b"], "group-by": ["user"], "timespan": "2h"})


Q["sigma_count"], Q["sigma_ordered"] = sigma_count, sigma_ordered


def process_tree(s, f):
    """A process forest over the events: signups boot a host, clicks start processes, errors end them."""
    ev = events_view(s, f)
    starts = ev.where("code = 'click'").select("id", F.col("source").alias("host"), "ts", (F.col("k") % 20).alias("pid"), (F.col("k") % 7).alias("ppid"), F.lit(None).cast("string").alias("guid"), F.lit(None).cast("string").alias("parent_guid"))
    ends = ev.where("code = 'error'").select(F.col("source").alias("host"), "ts", (F.col("k") % 20).alias("pid"))
    boots = ev.where("code = 'signup' and k < 5").select(F.col("source").alias("host"), "ts")
    return P.parents(P.instances(starts, ends, boots))


Q["process_tree"] = process_tree
O["process_tree"] = f"""{EV}, st as (select id, source as host, ts, k % 20 as pid, k % 7 as ppid from ev where code = 'click'), en as (select source as host, ts, k % 20 as pid from ev where code = 'error'), bo as (select source as host, ts from ev where code = 'signup' and k < 5),
    b as (select st.*, (select max(bo.ts) from bo where bo.host = st.host and bo.ts <= st.ts) as boot, (select min(en.ts) from en where en.host = st.host and en.pid = st.pid and en.ts >= st.ts) as stop from st),
    p as (select *, least(coalesce(stop, 4611686018427387904), coalesce(lead(ts) over (partition by host, boot, pid order by ts, id), 4611686018427387904)) as fin from b),
    f as (select c.id, count(p.id) as n, min(p.id) as parent from p c left join p on c.host = p.host and c.boot = p.boot and c.ppid = p.pid and p.ts < c.ts and c.ts < p.fin where c.ppid <> 0 and c.boot is not null group by 1)
    select p.id, case when f.n = 1 then f.parent end as parent, case when p.ppid = 0 then 'root' when p.boot is null then 'unknown_boot' when f.n = 1 then 'inferred_pid_lifetime' when f.n > 1 then 'ambiguous_pid' else 'missing_pid_parent' end as how from p left join f on f.id = p.id"""
QUERIES, ORACLE = Q, O
