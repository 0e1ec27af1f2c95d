"""Queries of units, orders, snapshots, memberships, paths, learned scores, transforms and files read from text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.events import EV_SQL, events_view
from logweave.functions import transforms as T
from logweave.operators import aggregates as A
from logweave.operators import behavior as B
from logweave.operators import learning as L
from logweave.operators import paging, roles, rules, sliding
from logweave.operators.aggregates import Measure as M
from logweave.plans import filters as P
from logweave.plans.filters import Filter
from logweave.plans.language import prefiltered, search
from logweave.queries.normalise import _SEC, _secured
from logweave.session import ensure_checkpoint_dir

EV = f"with {EV_SQL}"
Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


# ---- aggregation ----
@query(f"""{EV}, m as (select code as key, latency, case when code = 'purchase' then 0 else 3 end as kind from ev)
    select key, count(*) as count, case when key = 'purchase' then null else round(sum(latency)::double, 2) end as sum_v, key = 'purchase' as sum_v_mixed from m group by 1""")
def agg_units_dominant(s, f):
    """Groups whose unit isn't the one of most values have no sum."""
    ev = events_view(s, f).withColumn("v", F.concat("latency", F.when(F.col("code") == "purchase", "").otherwise(" ms")))
    return A.aggregate(ev, [], "code", [M("count"), M("sum", "v")], one_unit=True)


_KEYS = "case when k % 3 = 0 then k::varchar when k % 3 = 1 then 'Code-' || k else 'code-' || (k % 40) end"


@query(f"""{EV}, m as (select {_KEYS} as key, count(*) as count from ev group by 1) select * from m order by try_cast(key as double) is null, try_cast(key as double), lower(key), key limit 45""")
def agg_key_order(s, f):
    """The first groups in the order of keys: numbers before texts, texts regardless of letter case."""
    k = F.col("k")
    ev = events_view(s, f).withColumn("g", F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("Code-"), k)).otherwise(F.concat(F.lit("code-"), k % 40)))
    return A.aggregate(ev, [], "g", [M("count")], cap=45, by_key=True)


@query(f"""{EV} select source as key, strftime(make_timestamp(min(ts) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as min_ts, strftime(make_timestamp(max(ts) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as max_ts, count(*) as count from ev group by 1""")
def agg_instants(s, f):
    return A.aggregate(events_view(s, f), [], "source", [M("count"), M("min", "ts"), M("max", "ts")])


@query(f"""{EV}, m as (select * from ev where level = 'Erro'), p as (select id, row_number() over (order by ts, id) as n from m)
    select 'total' as part, null as key, count(*) as n from m union all select 'level', level, count(*) from m group by 2 union all select 'source', source, count(*) from m group by 2 union all select 'code', code, count(*) from m group by 2
    union all select 'page', id::varchar, n from p where n between 11 and 40""")
def explore_snapshot(s, f):
    return A.explore(events_view(s, f), [Filter("level", "equals", "Erro")], 10, 30)


@query(f"{EV}, m as (select id, size from ev where size is not null order by id limit 500) select 1 as kind, count(*) as seen from m")
def auto_unit(s, f):
    """The unit of most of the first 500 sizes in id order (1: bytes)."""
    ev = events_view(s, f)
    kind = A.dominant_unit(ev, "size", 500)
    return ev.where("size is not null").orderBy("id").limit(500).agg(F.lit(kind).alias("kind"), F.count("*").alias("seen"))


@query(f"""{EV}, c as (select source as c, count(*) as n from ev group by 1 order by 2 desc, 1 limit 4), m as (select code, case when source in (select c from c) then source else '(other)' end as col from ev)
    select code as path, 1 as depth, col, count(*) as count from m group by 1, 3 union all select code, 1, '(total)', count(*) from m group by 1""")
def pivot_capped(s, f):
    """Four columns of their own, the others together."""
    return A.pivot(events_view(s, f), ["code"], "source", [M("count")], 4)


@query(f"""{EV}, m as (select code as path, 1 as depth, source as col, id, "user" from ev union all select code, 1, '(total)', id, "user" from ev), r as (select *, row_number() over (partition by path, col order by id) as rn from m)
    select path, depth, col, count(*) as count, string_agg("user", ', ' order by id) filter (rn <= 50) || case when count(*) >= 50 then ', …' else '' end as users from r group by 1, 2, 3""")
def pivot_string_agg(s, f):
    return A.pivot(events_view(s, f), ["code"], "source", [M("count"), M("string_agg", "user", "users")])


# ---- memberships and paths ----
@query(f"{_SEC} select id from sec where command like 'bash%'")
def filter_threat_rule(s, f):
    ev = _secured(s, f).withColumn("message", F.coalesce(F.try_element_at("fields", F.lit("cmdline")), "message"))
    return P.apply(ev, Filter("", "threat_rule", "reverse-shell")).select("id")


@query(f"{_SEC} select id from sec where number = '4625' or number = '4624' and source = 'source-1'")
def filter_detection(s, f):
    """Events that some step of a rule selects; of successful logons only one source's."""
    facts = rules.flat(_secured(s, f))
    return P.apply(facts, Filter("", "detection", "T1110-guessed")).where("code = '4625' or source = 'source-1'").select("id")


@query(f"{_SEC} select id from sec where number = '1102' and source <> 'source-2'")
def lang_detection(s, f):
    return search(rules.flat(_secured(s, f)), "deteccao:T1070-log-cleared NOT source:source-2").select("id")


@query(f"{_SEC} select id from sec where command like 'bash%' and k < 50")
def lang_threat(s, f):
    ev = _secured(s, f).withColumn("message", F.coalesce(F.try_element_at("fields", F.lit("cmdline")), "message"))
    ev = ev.join(events_view(s, f).select("id", "k"), "id")
    return search(ev, "regra:reverse-shell k<50").select("id")


@query(f"{EV} select id, \"user\" as \"user\", (k % 5)::varchar as first, source as deep from ev where k % 5 > 2")
def lang_paths(s, f):
    """Paths into lists and objects, names in other letter case."""
    from logweave.events import column_of

    body = F.to_json(F.struct(F.array((F.col("k") % 5).cast("string"), F.lit("x")).alias("tags"), F.struct(F.struct(F.col("source").alias("e")).alias("d")).alias("a")))
    ev = events_view(s, f).select("id", F.create_map(F.lit("Doc"), body, F.lit("UserName"), F.col("user")).alias("fields"))
    got = search(ev, "Doc.tags.0>2 Doc.a.d.e:*")
    return got.select("id", column_of(got, "username").alias("user"), column_of(got, "Doc.tags.0").alias("first"), column_of(got, "Doc.a.d.e").alias("deep"))


@query(f"{EV}, g as (select source, count(*) as n from ev where code = 'error' group by 1), t as (select source from g order by n desc, source limit 1) select id from ev where code = 'error' and source in (select source from t)")
def filter_finding(s, f):
    """Members of a computed result."""
    ev = events_view(s, f)
    bad = ev.where("code = 'error'")
    top = bad.groupBy("source").count().orderBy(F.desc("count"), "source").first()
    results = bad.select("id", F.col("source").alias("finding"))
    return P.apply(ev, Filter("", "finding", top["source"] if top else ""), results=results).select("id")


@query(f"{EV} select id from ev where code = 'error' and k < 30 and source <> 'source-3'")
def set_selections(s, f):
    """Selections put together by their ids."""
    ev = events_view(s, f)
    return paging.combined("not", paging.combined("and", ev.where("code = 'error'"), ev.where("k < 30")), ev.where("source = 'source-3'"))


@query(f"{EV}, o as (select ts, source from ev where id = 500) select ev.id from ev, o where ev.source = o.source and ev.ts between o.ts - 7200000 and o.ts + 7200000")
def context_seconds(s, f):
    return paging.context_seconds(events_view(s, f), 500, 7200, "source").select("id")


@query(f"{EV}, h as (select id, ts from ev where contains(message, 'item 3')), c as (select id, ts from h order by ts, id limit 1 offset 49) select h.id, h.ts from h, c where h.ts > c.ts or h.ts = c.ts and h.id > c.id order by h.ts, h.id limit 40")
def search_page(s, f):
    """The second page of a search, after the cursor of the first."""
    ev, hit = events_view(s, f), F.contains(F.col("message"), F.lit("item 3"))
    last = paging.search_page(ev, hit, 50).collect()[-1]
    return paging.search_page(ev, hit, 40, (last["ts"], last["id"])).select("id", "ts")


@query(f"{EV} select id from ev where code = 'purchase' and contains(message, 'item')")
def lang_prefilter(s, f):
    """Lines are dropped by the words that a query requires before they are parsed."""
    ev = events_view(s, f)
    lines = ev.select(F.to_json(F.struct("id", "code", "message")).alias("line"))
    kept = prefiltered(lines, "code:purchase item")
    rows = kept.select(F.from_json("line", "id long, code string, message string").alias("r")).select("r.*")
    return search(rows, "code:purchase item").select("id")


# ---- behaviour, learning ----
@query(f"""{EV}, e as (select id, ts, "user", code from ev), t as (select c.id as third_id, c.ts as third, c."user", arg_max(b.id, (b.ts, a.ts, a.id, b.id)) as second_id, arg_max(a.id, (b.ts, a.ts, a.id, b.id)) as first_id, arg_max(a.ts, (b.ts, a.ts, a.id, b.id)) as first
      from e a join e b on a."user" = b."user" and a.ts < b.ts join e c on b."user" = c."user" and b.ts < c.ts where a.code = 'signup' and b.code = 'error' and c.code = 'purchase' group by 1, 2, 3)
    select "user", first_id, second_id, third_id, first, third as last from t where third - first <= 432000000""")
def behavior_takeover(s, f):
    """A signup, then an error, then a purchase of one user within five days."""
    ev = events_view(s, f).withColumn("action", F.col("code"))
    return B.takeover_chain(ev, ("signup", "error", "purchase"), ["user"], 432_000_000)


@query(f"""{EV}, n as (select source, ts, id, k as number, lag(k) over (partition by source order by ts, id) as before from ev)
    select source, ts, id, before, number, number - before - 1 as missing from n where number <> before + 1""")
def win_jumps(s, f):
    return sliding.sequence_jumps(events_view(s, f), ["source"], "k")


@query(f"""{EV}, p as (select source, code, k, count(*) as n from ev group by 1, 2, 3), m as (select *, sum(n) over (partition by source, code) as na, sum(n) over (partition by source, k) as nb, sum(n) over (partition by source) as total from p)
    select id, n, round(log2(na::double * nb / (total::double * n)), 6) as score from ev join m using (source, code, k) where n <= 2 and na >= 5 and nb >= 5""")
def learn_joint_novelty(s, f):
    return L.joint_novelty(events_view(s, f), "source", "code", "k", 2, 5)


@query(f"""{EV}, m as (select *, source || '/' || (k // 4) as slot from ev), r as (select slot, count(*) as n, avg((level = 'Erro')::int::double) as rate from m group by 1)
    select id, round(rate, 6) as rate, round(1 - rate, 6) as score from m join r using (slot) where level = 'Erro' and n >= 20 and rate <= 0.2""")
def learn_unexpected_failures(s, f):
    ev = events_view(s, f).withColumn("slot", F.concat_ws("/", "source", F.floor(F.col("k") / 4)))
    return L.unexpected_failures(ev, "slot", 20, 0.2)


@query(f"""{EV}, r as (select id, source, lag(code) over (partition by source order by ts, id) as before, code as after from ev), c as (select source, before, after, count(*) as n from r where before is not null group by 1, 2, 3),
    t as (select *, sum(n) over (partition by source, before) as total from c) select id, before, after, round(-log2(n / total), 6) as surprise from r join t using (source, before, after) where total >= 10""")
def learn_surprise(s, f):
    return L.sequence_surprise(events_view(s, f), "source", "code")


@query(f"""{EV}, b as (select *, case when ts - lag(ts) over (partition by source order by ts, id) <= 3600000 then 0 else 1 end as new from ev where level = 'Erro'), r as (select *, sum(new) over (partition by source order by ts, id) as run from b)
    select source as context, min(ts) as first, max(ts) as last, count(*) as n, count(distinct code) as codes from r group by source, run having count(*) >= 3""")
def learn_incidents(s, f):
    return L.incidents(events_view(s, f), "source", F.col("level") == "Erro", 3_600_000)


_W = "({p} {s} 1.96 * 1.96 / (2 * {n}) {o} 1.96 * sqrt({p} * (1 - {p}) / {n} + 1.96 * 1.96 / (4.0 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n})"


@query(f"""{EV}, x as (select (code = 'error' or k > 90)::int as b, unnest([{{'field': 'source', 'value': source}}, {{'field': 'k', 'value': k::varchar}}, {{'field': 'code', 'value': code}}]) as p from ev), c as (select p.field as field, p.value as value, count(*) as n, sum(b) as bad from x group by 1, 2),
    t as (select *, sum(n) over (partition by field) - n as n2, sum(bad) over (partition by field) - bad as b2 from c)
    select field, value, n, bad::bigint as bad, round(bad / n, 6) as rate, round(b2 / n2, 6) as others from t where n >= 20 and n2 >= 20 and {_W.format(p='(bad / n)', n='n', s='+', o='-')} > {_W.format(p='(b2 / n2)', n='n2', s='+', o='+')}""")
def learn_contrasts(s, f):
    return L.contrasts(events_view(s, f), (F.col("code") == "error") | (F.col("k") > 90), ["source", "k", "code"])


@query(f"""{EV} select source as context, '‹…› item ‹…› took ‹…› ms from ‹…›' as template, count(*) as n, count(distinct code) as members from ev group by 1""")
def learn_clusters(s, f):
    """Messages that differ in their first word share a template."""
    return L.cluster_templates(events_view(s, f), "source")


@query(f"""{EV}, r as (select id, source as context, lag(code) over (partition by source order by ts, id) as before, code as after from ev), c as (select context, before, after, 2 * count(*) as n from r where before is not null group by 1, 2, 3)
    select *, round(n / sum(n) over (partition by context, before), 6) as p from c""")
def learn_merged(s, f):
    """Two contributions of the same counts as one model."""
    one = L.transitions(events_view(s, f), "source", "code")
    return L.merged_models(one, one)


@query(f"{_SEC} select id, case when number in ('4625') then ip when url like '%passwd' then ip when command like 'bash%' then \"user\" when number in ('4732', '1102') then \"user\" end as attacker, case when number = '4625' or url like '%passwd' or command like 'bash%' or number in ('4732', '1102') then source end as target from sec where number in ('4625', '4732', '1102') or url like '%passwd' or command like 'bash%'")
def participants(s, f):
    got = roles.participants(_secured(s, f)).where("participants is not null")
    return got.select("id", "participants.attacker", "participants.target")


@query(f"""{EV} select 'a' as pack, "user" as link, a.id as first_id, b.id as second_id, a.ts as first_ts, b.ts as second_ts from ev a join ev b using ("user") where a.code = 'signup' and b.code = 'error' and b.ts > a.ts and b.ts - a.ts <= 7200000
    union all select 'b', source, a.id, b.id, a.ts, b.ts from ev a join ev b using (source) where a.code = 'purchase' and b.code = 'signup' and b.ts > a.ts and b.ts - a.ts <= 600000""")
def behavior_packs(s, f):
    ev = events_view(s, f).withColumn("action", F.col("code"))
    return B.packs(ev, (("a", "signup", "error", ("user",), 7_200_000), ("b", "purchase", "signup", ("source",), 600_000)))


@query(f"{EV} select id, code from ev qualify row_number() over (partition by code order by ('0x' || substr(md5(id || ':7'), 1, 15))::bigint, id) <= 15")
def sample_stratified(s, f):
    return paging.stratified(events_view(s, f), F.col("code"), 15).select("id", "code")


# ---- transforms ----
@query(f"{EV} select id, case when code = 'error' then \"user\" else 'k' || k end as who, case when code = 'error' then 0 else 1 end as rule, case when code = 'error' then 'user' else 'k' end as col from ev")
def field_advanced(s, f):
    """A field with the rule and column that gave it."""
    from logweave.functions.transforms import Rule
    from logweave.operators.examples import advanced_field

    got = advanced_field(events_view(s, f), "who", [Rule("user", r"^(user-\d+)$", "$1", (Filter("code", "equals", "error"),)), Rule("k", r"^(\d+)$", "k$1")])
    return got.select("id", "who", F.col("who_from.rule").alias("rule"), F.col("who_from.column").alias("col"))


@query(f"{EV} select id, latency::varchar as took from ev")
def field_by_example(s, f):
    """The number before ``ms``, from two marked samples."""
    from logweave.operators.examples import Example, extract_by_example

    marked = [Example(t, t.index("took ") + 5, t.index(" ms")) for t in ("view item 3 took 17 ms from 10.0.0.1", "error item 12 took 5 ms from 10.0.9.9")]
    return extract_by_example(events_view(s, f), "message", "took", marked).select("id", "took")

@query(f"""{EV} select id, source as host, code as "at", k::varchar as first, 'x' as second from ev""")
def transform_xml(s, f):
    text = F.concat(F.lit('<ev at="'), "code", F.lit('"><host>'), "source", F.lit("</host><n>"), "k", F.lit("</n><n>x</n></ev>"))
    got = T.exploded(events_view(s, f).select("id", text.alias("doc")), "doc", ["parse_xml"])
    take = lambda n: F.try_element_at("fields", F.lit(n))
    return got.select("id", take("doc.ev.host").alias("host"), take("doc.ev.@at").alias("at"), take("doc.ev.n.0").alias("first"), take("doc.ev.n.1").alias("second"))


@query(f"""{EV} select id, code as a, source || ', x' as b, len(regexp_extract_all(message, '[0-9]+')) as numbers from ev""")
def transform_extract(s, f):
    line = F.concat("code", F.lit(',"'), "source", F.lit(', x"'))
    ev = events_view(s, f)
    cells = T.delimited_fields(line, ["a", "b"])
    return ev.select("id", cells["a"].alias("a"), cells["b"].alias("b"), F.size(T.all_matches(F.col("message"), "[0-9]+")).alias("numbers"))


@query(f"{EV} select id, case when id % 2 = 0 then 1700000000000 + k * 1000 else ts end as ts from ev")
def retimestamped(s, f):
    """Times derived anew by a user's rule for some files, kept in others."""
    ev = events_view(s, f)
    raw = F.concat(F.lit("at <"), F.date_format(F.timestamp_millis(1_700_000_000_000 + F.col("k") * 1000), "dd.MM.yyyy HH:mm:ss"), F.lit("> x"))
    rows = ev.select("id", "ts", "message", raw.alias("raw"), F.when(F.col("id") % 2 == 0, "a.log").otherwise("b.log").alias("part_file"))
    return roles.retimestamp(rows, [{"file": "^a", "pattern": r"<([^>]+)>"}]).select("id", "ts")


# ---- files ----
def _written(s: SparkSession, rows: DataFrame, suffix: str = "") -> str:
    """A folder of text files of the rows' lines, in the shared folder for intermediate data, removed when the session's process ends."""
    ensure_checkpoint_dir(s)
    folder = f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/text-{uuid.uuid4().hex}{suffix}"
    rows.write.text(folder)
    path = s._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(s._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def _iso(c):
    return F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


@query(f"{EV} select ts, level, source, code, message, \"user\" from ev")
def read_jsonl(s, f):
    """All events written as JSON lines and read."""
    from logweave.sources.readers import read

    ev = events_view(s, f)
    body = F.to_json(F.struct(_iso(F.col("ts")).alias("@timestamp"), F.upper("level").alias("level"), F.col("source").alias("service"), F.col("code").alias("event_id"), "message", F.struct(F.col("user").alias("name")).alias("user")))
    got = read(s, _written(s, ev.select(body)))
    return got.select("ts", "level", "source", "code", "message", F.try_element_at("fields", F.lit("user.name")).alias("user"))


@query(f"{EV} select ts - ts % 1000 as ts, level, source, message || chr(10) || '\"' || \"user\" || '\"; end' as message, 'parsed' as parse_status from ev")
def read_csv(s, f):
    """All events written as delimited records of two lines, with quotes, and read, whichever blocks the files are read in."""
    from logweave.sources.readers import read

    ev = events_view(s, f)
    text = F.concat(F.lit('"'), "message", F.lit('\n""'), "user", F.lit('""; end"'))
    lines = F.concat_ws(";", F.date_format(F.timestamp_millis("ts"), "dd/MM/yyyy"), F.date_format(F.timestamp_millis("ts"), "HH:mm:ss"), "level", "source", text)
    rows = ev.select(lines.alias("value"))
    # every file has its own header: the first row of each task's file
    rows = rows.mapInPandas(_with_header, "value string")
    return read(s, _written(s, rows)).select("ts", "level", "source", "message", "parse_status")


def _with_header(batches):
    import pandas as pd

    for k, b in enumerate(batches):
        yield b if k else pd.concat([pd.DataFrame({"value": ["Data;Hora;Nível;Origem;Mensagem"]}), b[["value"]]])


@query(f"{EV} select ts, level, source, message || chr(10) || '  at x.y.Z(Z.java:' || k || ')' as message from ev")
def read_program_log(s, f):
    """All events written as entries of a program's log, each over two lines, and read."""
    from logweave.sources.readers import read

    ev = events_view(s, f)
    stamp = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd HH:mm:ss,SSS")
    word = F.when(F.col("level") == "Erro", "ERROR").when(F.col("level") == "Aviso", "WARN").otherwise("INFO")
    entry = F.concat(stamp, F.lit(" "), word, F.lit(" [main] "), "source", F.lit(" - "), "message", F.lit("\n  at x.y.Z(Z.java:"), "k", F.lit(")"))
    return read(s, _written(s, ev.select(entry))).select("ts", "level", "source", "message")


@query(f"{EV} select ts, source, code, \"user\" from ev")
def read_xml_records(s, f):
    from logweave.sources.readers import read_xml

    ev = events_view(s, f)
    text = F.concat(F.lit("<Event><System><TimeCreated SystemTime=\""), _iso(F.col("ts")), F.lit("\"/><EventID>"), "code", F.lit("</EventID><Computer>"), "source", F.lit("</Computer></System><EventData><Data Name=\"User\">"), "user", F.lit("</Data></EventData></Event>"))
    got = read_xml(s, _written(s, ev.select(text)))
    return got.select("ts", "source", "code", F.try_element_at("fields", F.lit("User")).alias("user"))


# ---- bounds and recursion ----
@query("select l_returnflag, true as parts_near, true as prices_near from lineitem group by 1")
def sketch_bounds(s, f):
    """Whether the sketches' estimates lie within their bounds of the exact values."""
    from logweave.tables import table

    li = table(s, f, "lineitem")
    got = li.groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 14)).alias("parts"), F.count_distinct("l_partkey").alias("exact"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("price"),
        F.percentile("l_extendedprice", 0.49).alias("low"), F.percentile("l_extendedprice", 0.51).alias("high"))
    near = F.abs(F.col("parts") - F.col("exact")) <= F.greatest(F.col("exact") * 0.05, F.lit(2))
    return got.select("l_returnflag", near.alias("parts_near"), F.col("price").between(F.col("low"), F.col("high")).alias("prices_near"))


QUERIES, ORACLE = Q, O
