"""Joins, windows, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from logweave.events import EV_SQL, events_view
from logweave.functions.net import ipv4_number
from logweave.operators import joins as J
from logweave.operators import sliding as S
from logweave.tables import table

EV = f"with {EV_SQL}"
Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


for _how, _sql in {"inner": "join", "left": "left join", "right": "right join", "full": "full join"}.items():
    Q[f"join_{_how}"] = lambda s, f, h=_how: table(s, f, "customer").join(
        table(s, f, "orders"), F.col("c_custkey") == F.col("o_custkey"), h).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")
    O[f"join_{_how}"] = f"select c_custkey, c_name, o_orderkey, o_totalprice from customer {_sql} orders on c_custkey = o_custkey"


for _how, _sql in {"left": "left join", "right": "right join", "full": "full join"}.items():  # rows without a partner on either side
    Q[f"join_{_how}_open"] = lambda s, f, h=_how: table(s, f, "customer").where("c_acctbal > 0").join(
        table(s, f, "orders").where("o_orderstatus <> 'F'"), F.col("c_custkey") == F.col("o_custkey"), h).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")
    O[f"join_{_how}_open"] = f"select c_custkey, c_name, o_orderkey, o_totalprice from (select * from customer where c_acctbal > 0) c {_sql} (select * from orders where o_orderstatus <> 'F') o on c_custkey = o_custkey"


@query("select * from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def join_semi(s, f):
    return table(s, f, "customer").join(table(s, f, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("select * from customer c where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def join_anti(s, f):
    return table(s, f, "customer").join(table(s, f, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("select a.r_name as a, b.r_name as b from region a join region b on a.r_regionkey < b.r_regionkey")
def join_theta(s, f):
    r = table(s, f, "region")  # a fixed table of five rows
    return r.alias("a").join(F.broadcast(r.alias("b")), F.col("a.r_regionkey") < F.col("b.r_regionkey")).select(F.col("a.r_name").alias("a"), F.col("b.r_name").alias("b"))


@query("select n_name, count(*) as pairs from supplier join customer on s_nationkey = c_nationkey join nation on n_nationkey = c_nationkey group by n_name")
def join_self_aggregated(s, f):
    """Pairs by nation, counted from both sides' counts: the pairs themselves are never made."""
    a = table(s, f, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("a"))
    b = table(s, f, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("b"))
    return a.join(b, "n_nationkey").join(table(s, f, "nation"), "n_nationkey").select("n_name", (F.col("a") * F.col("b")).alias("pairs"))


_CATALOG = """u(source, code, name, description) as (values ('source-1', 'error', 'falha', 'u1'), ('*', 'click', 'clique', 'u2')),
    y(source, code, name, description) as (values ('source-1', 'click', 'sc', 's1'), ('*', 'view', 'visita', 's2'), ('source-2', 'error', 'e2', 's3'), ('*', 'error', 'erro', 's4'))"""


@query(f"""{EV}, {_CATALOG} select id, coalesce(a.name, b.name, c.name, d.name) as name, coalesce(a.description, b.description, c.description, d.description) as description from ev
    left join u a on a.source = ev.source and a.code = ev.code left join u b on b.source = '*' and b.code = ev.code
    left join y c on c.source = ev.source and c.code = ev.code left join y d on d.source = '*' and d.code = ev.code""")
def join_broadcast_catalog(s, f):
    names = ["source", "code", "name", "description"]
    user = s.createDataFrame([("source-1", "error", "falha", "u1"), ("*", "click", "clique", "u2")], names)
    system = s.createDataFrame([("source-1", "click", "sc", "s1"), ("*", "view", "visita", "s2"), ("source-2", "error", "e2", "s3"), ("*", "error", "erro", "s4")], names)
    return J.enrich_from_catalog(events_view(s, f), user, system).select("id", "name", "description")


@query(f"""{EV}, l as (select * from ev where code = 'purchase'), r as (select source, ts as rts, max(id) as rid from ev where code = 'error' group by 1, 2)
    select l.id, r.rid, r.rts from l asof left join r on l.source = r.source and l.ts >= r.rts""")
def join_asof(s, f):
    ev = events_view(s, f)
    left, right = ev.where("code = 'purchase'"), ev.where("code = 'error'").select("source", F.col("ts").alias("rts"), F.col("id").alias("rid"))
    return J.as_of_join(left, right, ["source"], "ts", "rts", ["rid", "rts"]).select("id", "rid", "rts")


@query(f"{EV} select a.id as a_id, b.id as b_id, b.ts - a.ts as gap from ev a join ev b on a.\"user\" = b.\"user\" and b.ts > a.ts and b.ts - a.ts <= 3600000 where a.code = 'error' and b.code = 'purchase'")
def join_band(s, f):
    ev = events_view(s, f)
    a = ev.where("code = 'error'").select("user", F.col("ts").alias("a_ts"), F.col("id").alias("a_id"))
    b = ev.where("code = 'purchase'").select("user", F.col("ts").alias("b_ts"), F.col("id").alias("b_id"))
    return J.band_join(a, b, ["user"], "a_ts", "b_ts", 3_600_000).select("a_id", "b_id", (F.col("b_ts") - F.col("a_ts")).alias("gap"))


@query(f"{EV} select id, case when a between 167772160 and 167772255 then 'norte' when a between 167772416 and 167772671 then 'sul' when a between 167772900 and 167773250 then 'leste' end as net "
       "from (select id, 167772160 + string_split(ip, '.')[3]::bigint * 256 + string_split(ip, '.')[4]::bigint as a from ev)")  # fmt: skip
def join_ip_range(s, f):
    ranges = s.createDataFrame([(167772160, 167772255, "norte"), (167772416, 167772671, "sul"), (167772900, 167773250, "leste")], "lo long, hi long, net string")
    return J.range_lookup(events_view(s, f).withColumn("a", ipv4_number(F.col("ip"))), "a", ranges, "lo", "hi", ["net"]).select("id", "net")


@query("select o_orderkey, c_name, c_mktsegment from orders left join customer on o_custkey = c_custkey")
def join_lookup(s, f):
    orders = table(s, f, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.reference_lookup(orders, table(s, f, "customer"), ["c_custkey"], ["c_name", "c_mktsegment"]).select("o_orderkey", "c_name", "c_mktsegment")


@query(f"{EV} select id, case ip when '10.0.3.56' then 'HXXP://10.0[.]3.56:443/' else '10.0.4.68.' end as indicator, 'ip' as kind from ev where ip in ('10.0.3.56', '10.0.4.68')")
def join_indicators(s, f):
    known = s.createDataFrame([("HXXP://10.0[.]3.56:443/", "ip"), ("10.0.4.68.", "ip"), ("evil.example", "domain")], "indicator string, kind string")
    return J.indicator_match(events_view(s, f), "ip", known).select("id", "indicator", "kind")


@query(f"""{EV}, r as (select source, ts, "user" as k1, ip as k2 from ev where id % 2 = 0 union all select source || 'x', ts, ip, code || k from ev where id % 2 = 1),
    g as (select k2 from r group by k2 having count(*) <= 64)
    select a.k2 as mid, a.k1 as "from", b.k2 as "to", count(*) as n, min(a.ts) as first from r a join r b on a.k2 = b.k1 and b.ts >= a.ts and b.ts - a.ts <= 3600000 and a.source <> b.source
    where a.k2 in (select k2 from g) group by 1, 2, 3""")
def join_bridges(s, f):
    ev = events_view(s, f)
    a = ev.where("id % 2 = 0").select("source", "ts", F.col("user").alias("k1"), F.col("ip").alias("k2"))
    b = ev.where("id % 2 = 1").select(F.concat("source", F.lit("x")).alias("source"), "ts", F.col("ip").alias("k1"), F.concat("code", F.col("k").cast("string")).alias("k2"))
    return J.bridges(a.unionByName(b))


@query("with recursive t(node, ancestor, distance) as (select p_partkey, p_partkey // 3, 1 from part where p_partkey > 0 union all select node, ancestor // 3, distance + 1 from t where ancestor > 0) select * from t")
def recursive_ancestors(s, f):
    p = table(s, f, "part").select(F.col("p_partkey").alias("c"), F.when(F.col("p_partkey") > 0, (F.col("p_partkey") / 3).cast("long")).alias("p"))
    return J.ancestors(p, "c", "p")


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey and o_totalprice > c_acctbal) as n from customer")
def join_correlated_count(s, f):
    table(s, f, "orders").createOrReplaceTempView("lw_orders")
    table(s, f, "customer").createOrReplaceTempView("lw_customer")
    j = table(s, f, "customer").join(table(s, f, "orders"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal")), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


_W = "(partition by source order by ts, id)"
_FULL = "(partition by source order by ts, id rows between unbounded preceding and unbounded following)"


@query(f"{EV} select id, row_number() over {_W} as row_number, rank() over {_W} as rank, dense_rank() over {_W} as dense_rank, round(percent_rank() over {_W}, 6) as percent_rank, "
       f"round(cume_dist() over {_W}, 6) as cume_dist, ntile(4) over {_W} as ntile, first_value(id) over {_FULL} as first_id, last_value(id) over {_FULL} as last_id, nth_value(id, 3) over {_FULL} as third_id from ev")  # fmt: skip
def win_rank_all(s, f):
    return S.ranks(events_view(s, f), ["source"], [F.col("ts"), F.col("id")]).select("id", "row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "first_id", "last_id", "third_id")


@query(f"{EV} select id, ts - lag(ts) over {_W} as since, lead(code) over {_W} as next_code from ev")
def win_lag_lead(s, f):
    w = Window.partitionBy("source").orderBy("ts", "id")
    return events_view(s, f).select("id", (F.col("ts") - F.lag("ts").over(w)).alias("since"), F.lead("code").over(w).alias("next_code"))


_R = "(partition by \"user\" order by ts range between 7200000 preceding and current row)"


@query(f"{EV} select id, count(*) over {_R} as win_n, count(distinct code) over {_R} as win_distinct, count(*) filter (level = 'Erro') over {_R} as win_flagged, sum(latency) over {_R} as win_sum, "
       f"round(avg(latency) over {_R}, 6) as win_avg, min(latency) over {_R} as win_min, max(latency) over {_R} as win_max from ev")  # fmt: skip
def win_range_ms(s, f):
    out = S.with_sliding(events_view(s, f), ["user"], 7_200_000, "code", F.col("level") == "Erro", F.col("latency"))
    return out.select("id", "win_n", "win_distinct", "win_flagged", "win_sum", F.round("win_avg", 6).alias("win_avg"), "win_min", "win_max")


@query(f"{EV}, h as (select *, count(*) over (partition by source order by ts range between 3600000 preceding and current row) as win_n from ev), x as (select * from h where win_n >= 4), "
       "n as (select *, case when ts - lag(ts) over (partition by source order by ts, id) <= 3600000 then 0 else 1 end as b from x), "
       "r as (select *, sum(b) over (partition by source order by ts, id) as run from n) select source, min(ts) as first, max(ts) as last, count(*) as hits, max(win_n) as peak from r group by source, run")  # fmt: skip
def win_islands(s, f):
    return S.islands(S.with_sliding(events_view(s, f), ["source"], 3_600_000), ["source"], 3_600_000, F.col("win_n") >= 4)


@query(f"{EV}, h as (select *, count(*) over (partition by source order by ts range between 3600000 preceding and current row) as win_n from ev), "
       "e as (select *, lag(win_n >= 3) over (partition by source order by ts, id) as before from h) select id, win_n from e where win_n >= 3 and not coalesce(before, false)")  # fmt: skip
def win_edges(s, f):
    return S.rising_edges(S.with_sliding(events_view(s, f), ["source"], 3_600_000), ["source"], F.col("win_n") >= 3).select("id", "win_n")


@query(f"{EV}, g as (select source, lag(ts) over {_W} as gap_start, ts as gap_end from ev) select *, gap_end - gap_start as gap_ms from g where gap_end - gap_start >= 18000000")
def win_gaps(s, f):
    return S.gaps(events_view(s, f), ["source"], 18_000_000)


_SETS = {"union": ("union", lambda a, b: a.union(b).distinct()), "union_all": ("union all", lambda a, b: a.unionAll(b)), "intersect": ("intersect", lambda a, b: a.intersect(b)),
         "intersect_all": ("intersect all", lambda a, b: a.intersectAll(b)), "except": ("except", lambda a, b: a.subtract(b)), "except_all": ("except all", lambda a, b: a.exceptAll(b))}
for _k, (_sql, _fn) in _SETS.items():
    Q[f"set_{_k}"] = lambda s, f, fn=_fn: fn(table(s, f, "customer").select(F.col("c_nationkey").alias("n")), table(s, f, "supplier").where("s_nationkey > 5").select(F.col("s_nationkey").alias("n")))
    O[f"set_{_k}"] = f"select c_nationkey as n from customer {_sql} select s_nationkey from supplier where s_nationkey > 5"


@query("select distinct event_type as code, user_id % 7 as m from events")
def set_distinct(s, f):
    return table(s, f, "events").select(F.col("event_type").alias("code"), (F.col("user_id") % 7).alias("m")).distinct()


@query("select c_name as name, c_acctbal as balance, null::integer as size from customer union all by name select p_name as name, p_size as size from part")
def union_by_name(s, f):
    a = table(s, f, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(table(s, f, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size")), allowMissingColumns=True)


@query("select p_partkey, upper(p_name) as up, length(p_name) as len, split_part(p_name, ' ', 2) as second, replace(p_type, 'O', '0') as rep, left(p_name, 3) as l, right(p_name, 3) as r, reverse(p_brand) as rev, "
       "strpos(p_name, 'i') as pos, lpad(p_brand, 10, '.') as pad, levenshtein(p_name, p_type) as lev, concat_ws('-', p_brand, p_type) as ws, starts_with(p_name, 'red') as st, ends_with(p_name, 'ring') as en from part")  # fmt: skip
def fn_string(s, f):
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return table(s, f, "part").select("p_partkey", F.upper(n).alias("up"), F.length(n).alias("len"), F.split_part(n, F.lit(" "), F.lit(2)).alias("second"), F.replace(t, F.lit("O"), F.lit("0")).alias("rep"),
        F.left(n, F.lit(3)).alias("l"), F.right(n, F.lit(3)).alias("r"), F.reverse(b).alias("rev"), F.instr(n, "i").alias("pos"), F.lpad(b, 10, ".").alias("pad"), F.levenshtein(n, t).alias("lev"),
        F.concat_ws("-", b, t).alias("ws"), F.startswith(n, F.lit("red")).alias("st"), F.endswith(n, F.lit("ring")).alias("en"))


@query("select p_partkey, abs(-p_size) as a, ceil(p_retailprice / 7)::bigint as c, floor(p_retailprice / 7)::bigint as fl, round(p_retailprice / 7, 2) as r, round(sqrt(p_size), 6) as s, round(ln(p_size + 1), 6) as ln, "
       "round(log10(p_size + 1), 6) as lg, round(exp(p_size / 10.0), 4) as e, sign(p_size - 20)::int as sg, greatest(p_size, 20) as g, least(p_size, 20) as le, p_size % 7 as m, round(power(p_size, 1.5), 4) as pw from part")  # fmt: skip
def fn_math(s, f):
    z, p = F.col("p_size"), F.col("p_retailprice")
    return table(s, f, "part").select("p_partkey", F.abs(-z).alias("a"), F.ceil(p / 7).alias("c"), F.floor(p / 7).alias("fl"), F.round(p / 7, 2).alias("r"), F.round(F.sqrt(z), 6).alias("s"), F.round(F.log(z + 1), 6).alias("ln"),
        F.round(F.log10(z + 1), 6).alias("lg"), F.round(F.exp(z / 10.0), 4).alias("e"), F.signum(z - 20).cast("int").alias("sg"), F.greatest(z, F.lit(20)).alias("g"), F.least(z, F.lit(20)).alias("le"), (z % 7).alias("m"),
        F.round(F.pow(z, F.lit(1.5)), 4).alias("pw"))


@query("select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, strftime(o_orderdate, '%Y-%m') as mon, quarter(o_orderdate) as q, strftime(o_orderdate, '%d/%m/%Y') as txt, "
       "epoch_us(o_orderdate) // 1000 as ms, date_diff('day', timestamp '1995-01-01', o_orderdate) as days, dayofweek(o_orderdate) + 1 as dow from orders")  # fmt: skip
def fn_date(s, f):
    d = F.col("o_orderdate")
    return table(s, f, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d"), F.date_format(d, "yyyy-MM").alias("mon"), F.quarter(d).alias("q"), F.date_format(d, "dd/MM/yyyy").alias("txt"),
        F.unix_millis(d.cast("timestamp")).alias("ms"), F.datediff(d, F.lit("1995-01-01")).cast("long").alias("days"), F.dayofweek(d).alias("dow"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_valid(props) as ok, len(json_keys(props)) as n, json_extract_string(props, '$.missing') as missing from events")
def fn_json(s, f):
    return table(s, f, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.try_parse_json("props").isNotNull().alias("ok"), F.size(F.json_object_keys("props")).alias("n"),
        F.get_json_object("props", "$.missing").alias("missing"))


@query(r"select p_partkey, regexp_matches(p_name, '^(red|small)') as m, regexp_extract(p_name, '(\w+) (\w+)', 2) as x, regexp_replace(p_name, '[aeiou]', '*', 'g') as r, len(regexp_extract_all(p_brand, '\d')) as n, "
       r"regexp_full_match(p_type, '[A-Z]+') as fu, string_split_regex(p_name, '[ -]')[1] as sp from part")  # fmt: skip
def fn_regex(s, f):
    n = F.col("p_name")
    return table(s, f, "part").select("p_partkey", n.rlike("^(red|small)").alias("m"), F.regexp_extract(n, r"(\w+) (\w+)", 2).alias("x"), F.regexp_replace(n, "[aeiou]", "*").alias("r"),
        F.size(F.regexp_extract_all("p_brand", F.lit(r"(\d)"), F.lit(1))).alias("n"), F.col("p_type").rlike(r"^(?:[A-Z]+)\z").alias("fu"), F.split(n, "[ -]")[0].alias("sp"))


@query("select doc_id, md5(coalesce(text, '')) as m, sha256(coalesce(text, '')) as s from documents")
def fn_hash(s, f):
    t = F.coalesce("text", F.lit(""))
    return table(s, f, "documents").select("doc_id", F.md5(t).alias("m"), F.sha2(t, 256).alias("s"))


@query("select doc_id, coalesce(lang, source) as c, nullif(lang, 'pt') as n, lang is null as i, try_cast(source as integer) as t, case when n_chars > 500 then 'long' when n_chars is null then 'none' else 'short' end as size, ifnull(n_chars, 0) as z from documents")
def fn_null(s, f):
    d = table(s, f, "documents")
    return d.select("doc_id", F.coalesce("lang", "source").alias("c"), F.nullif("lang", F.lit("pt")).alias("n"), F.col("lang").isNull().alias("i"), F.col("source").try_cast("int").alias("t"),
        F.when(F.col("n_chars") > 500, "long").when(F.col("n_chars").isNull(), "none").otherwise("short").alias("size"), F.ifnull("n_chars", F.lit(0)).alias("z"))


@query("select l_returnflag, count(*) as n, round(stddev_samp(l_quantity), 6) as sd, round(var_pop(l_quantity), 6) as vp, median(l_quantity) as med, quantile_disc(l_quantity, 0.9) as q, bool_or(l_tax > 0.07) as o, "
       "arg_min(l_quantity, (l_orderkey, l_partkey, l_linenumber)) as am, count(distinct l_suppkey) as d, mode(l_linestatus) as mo from lineitem group by 1")  # fmt: skip
def fn_aggregates(s, f):
    return table(s, f, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("vp"), F.median("l_quantity").alias("med"),
        F.expr("percentile_disc(0.9) within group (order by l_quantity)").alias("q"), F.bool_or(F.col("l_tax") > 0.07).alias("o"), F.min_by("l_quantity", F.struct("l_orderkey", "l_partkey", "l_linenumber")).alias("am"),
        F.count_distinct("l_suppkey").alias("d"), F.mode("l_linestatus").alias("mo"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as q, count(*) as n, grouping(l_returnflag) * 2 + grouping(l_linestatus) as g from lineitem group by cube (l_returnflag, l_linestatus)")
def agg_cube(s, f):
    return table(s, f, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.grouping_id().alias("g"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as q, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def agg_rollup(s, f):
    return table(s, f, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))


def sketches(s, f):
    """Approximate distinct values, quantiles and frequent values of lineitem by mergeable sketches."""
    li = table(s, f, "lineitem")
    return li.groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 14)).alias("parts"), F.percentile_approx("l_extendedprice", [0.5, 0.95], 1000).alias("prices"),
        F.expr("approx_top_k(l_suppkey, 8)").alias("suppliers"))


Q["sketches"] = sketches
QUERIES, ORACLE = Q, O
