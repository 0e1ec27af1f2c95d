import pytest
from pyspark.sql import functions as F

from logweave.operators import detect as D
from logweave.operators import discover as X
from logweave.operators.joins import ancestors, as_of_join, bridges, indicator_match, reference_lookup
from logweave.plans import console
from logweave.plans.filters import Filter, apply
from logweave.plans.language import Parser, QueryError, search
from logweave.functions import formats, transforms
from logweave.functions.net import in_net, ip_scope
from logweave.functions.units import num_unit, unit_kind

ROWS = [
    (1, 1000, "AÇÃO concluída", "Erro", "10 MB", {"user": "ana", "request.path": "/a"}), (2, 2000, "timeout 12 ms", "Aviso", "2,5 KB", {"user": "bob"}), (3, None, None, None, None, None), (4, 4000, "", "Informação", "abc", {"USER": "x"}),
]
SCHEMA = "id long, ts long, message string, level string, size string, fields map<string,string>"


@pytest.fixture(scope="module")
def ev(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("f, want", [
    (Filter("message", "contains", "ação"), [1]), (Filter("message", "not_contains", "ação"), [2, 3, 4]), (Filter("message", "empty"), [3, 4]), (Filter("message", "not_empty"), [1, 2]), (Filter("size", "gt", "3 kb"), [1]), (Filter("size", "not_gt", "3 kb"), [2, 3, 4]),
    (Filter("user", "equals", "ANA"), [1]), (Filter("request.path", "equals_exact", "/a"), [1]), (Filter("level", "not_in", "erro,aviso"), [3, 4]), (Filter("message", "regex", "^$"), [3, 4]), (Filter("message", "term", "12 Timeout"), [2]), (Filter("nowhere", "contains", "x"), []),
    (Filter("message", "search", "ação", "i"), [1]), (Filter("nowhere", "not_equals", "x"), [1, 2, 3, 4]),
])
def test_filters(ev, f, want):
    assert ids(apply(ev, f)) == want


def test_bad_filters(ev):
    for f in (Filter("size", "gt", "much"), Filter("size", "zap", "1"), Filter("message", "term", "")):
        with pytest.raises(ValueError):
            apply(ev, f)


@pytest.mark.parametrize("q, want", [
    ("", [1, 2, 3, 4]), ("ação", [1]), ("timeout OU nível:erro", [1, 2]), ("NÃO message:*", [3, 4]), ("-level:erro user:ana", []), ("size>=1mb", [1]), ("NOT size>=1mb", [2, 3, 4]), ("user:(ana bob)", [1, 2]), ("size:1..3000", [2]), ('message="timeout 12 ms"', [2]),
    ("user:a*", [1]), ("message:/tim.out/", [2]), ("(level:erro || level:aviso) && !user:bob", [1]), ("request.path:/a", [1]), ("user:b?b", [2]), ("ana", [1]),
])
def test_language(ev, q, want):
    assert ids(search(ev, q)) == want


@pytest.mark.parametrize("q", ["(a", "user:", "a)", "size:9..1", "NOT", "size>x"])
def test_language_errors(ev, q):
    with pytest.raises(QueryError):
        search(ev, q)


def test_syntax_tree():
    t = Parser("a b OR NOT c:d").parse()
    assert t.kind == "or" and t.children[0].kind == "and" and t.children[1].kind == "not"


def test_units_and_nets(spark):
    df = spark.createDataFrame([("1,5 s",), ("2 GB",), ("1e3",), ("-0",), ("12d",), ("x",), ("",), (None,), ("3 parsecs",)], "v string")
    got = [(r[0], r[1]) for r in df.select(num_unit(F.col("v")), unit_kind(F.col("v"))).collect()]
    assert got == [(1500.0, 3), (2147483648.0, 1), (1000.0, 0), (0.0, 0), (12 * 8.64e7, 3), (None, None), (None, None), (None, None), (None, None)]
    n = spark.createDataFrame([("10.1.2.3:80",), ("::ffff:10.0.0.1",), ("[2001:db8::5]:443",), ("fe80::1",), ("8.8.8.8",), ("300.1.1.1",), (None,), ("::1",)], "ip string")
    assert [r[0] for r in n.select(ip_scope(F.col("ip"))).collect()] == ["privado", "privado", "reservado", "link-local", "público", None, None, "loopback"]
    assert [r[0] for r in n.select(in_net(F.col("ip"), "2001:db8::/32")).collect()] == [False, False, True, False, False, False, False, False]


def test_console_guard(ev):
    assert console.execute(ev, "with a as (select id from events where level = 'Erro') select count(*) as n from a;").first()["n"] == 1
    for bad in ("delete from events", "select * from other", "select 1; select 2", "select java_method('a','b') from events", "select * from range(5)", "with events as (select 1) select * from events", "select reflect('a', 'b')"):
        with pytest.raises(console.Refused):
            console.check(ev, bad)


def test_transforms(spark):
    df = spark.createDataFrame([("aGVsbG8",), ("%%%",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(transforms.step(F.col("t"), "base64url_decode")).collect()] == ["hello", None, None, None]
    jwt = spark.createDataFrame([("x.eyJzdWIiOiJhbmEifQ.y",), ("x",), ("a.b.c",)], "t string")
    assert [r[0] for r in jwt.select(transforms.step(F.col("t"), "jwt_payload")).collect()] == ['{"sub":"ana"}', None, None]
    with pytest.raises(ValueError):
        transforms.transform(F.col("t"), ["trim"] * 9)
    with pytest.raises(ValueError):
        transforms.compile_grok("%{NOPE:x}")


def test_formats(spark):
    lines = {
        "cef": r"CEF:0|Acme|Wall|1.0|100|worm \| stopped|10|src=10.0.0.1 msg=two words here spt=1232",
        "leef": "LEEF:1.0|Acme|Box|2|login|src=1.2.3.4\tusrName=ana b\tsev=5",
        "s5424": '<165>1 2025-01-01T00:00:00Z h app 7 ID [ex@1 iut="3" src="App"] text',
        "access": '1.2.3.4 - ana [27/Oct/2024:02:53:59 +0200] "GET /a?x=1 HTTP/1.1" 200 5 "-" "curl/8.0" rt=0.1',
        "audit": 'type=PROCTITLE msg=audit(1700000000.123:45): proctitle=6C73002D6C uid=0',
        "ua": "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0.0.0 Safari/537.36",
    }
    one = lambda text, parts: spark.createDataFrame([(text,), (None,)], "t string").select(*[c.alias(k) for k, c in parts.items()]).collect()
    c = F.col("t")
    got = one(lines["cef"], formats.cef(c))
    assert got[0]["name"] == r"worm \| stopped" and got[0]["extension"] == {"src": "10.0.0.1", "msg": "two words here", "spt": "1232"} and got[1]["extension"] is None
    assert one(lines["leef"], formats.leef(c))[0]["attributes"] == {"src": "1.2.3.4", "usrName": "ana b", "sev": "5"}
    s = formats.syslog5424(c)
    got = one(lines["s5424"], s | {"sd": formats.structured_data(s["data"])})[0]
    assert (got["facility"], got["severity"], got["sd"]) == (20, 5, {"sd.ex@1.iut": "3", "sd.ex@1.src": "App"})
    got = one(lines["access"], formats.access_log(c))[0]
    assert (got["method"], got["path"], got["status"], got["referer"], got["user"], got["rest"]) == ("GET", "/a?x=1", "200", None, "ana", "rt=0.1")
    got = one(lines["audit"], formats.auditd(c))[0]
    assert got["proctitle"] == "ls -l" and got["fields"]["uid"] == "0"
    got = one(lines["ua"], formats.user_agent(c))[0]
    assert (got["class"], got["family"], got["version"], got["os"], got["anomaly"]) == ("navegador", "Chrome", "120.0.0.0", "Windows", None)
    trace = "a.B: x\n\tat a.B.c(B.java:1)\njava.io.IOException: y\n\tat q.W.e(W.java)\nCaused by: z.RootError: k\n\tat z.Z.z(Z.java:2)"
    got = one(trace, formats.stack_trace(c))
    assert got[0]["class"] == "java.io.IOException" and got[0]["root_cause"] == "z.RootError" and got[0]["frames"] == 3 and got[1]["class"] is None


def test_sequence_consumes_events(spark):
    rows = [(1, 0, "g", "a"), (2, 10, "g", "b"), (3, 20, "g", "b"), (4, 30, "g", "a"), (5, 30, "g", "b"), (6, 40, "g", "b"), (7, 999, "h", "b"), (8, 1000, "h", "a"), (9, None, "h", "b")]
    df = spark.createDataFrame(rows, "id long, ts long, k string, c string")
    steps = [F.col("c") == "a", F.col("c") == "b"]
    got = sorted(tuple(r["events"]) for r in D.sequence(df, steps, ["k"], 100).collect())
    assert got == [(1, 2), (4, 6)]
    loose = {(r["k"], tuple(sorted(r["events"]))) for r in D.sequence(df, steps, ["k"], 100, False).collect()}
    assert ("h", (7, 8)) in loose and len(loose) == 3
    assert D.sequence(df.limit(0), steps, ["k"], 100).count() == 0


def test_episodes(spark):
    m = spark.createDataFrame([("f1", "e1"), ("f2", "e1"), ("f2", "e2"), ("f3", "e2"), ("f4", "e9")], "finding string, event_ref string")
    assert {(r[0], r[1]) for r in D.episodes(m).collect()} == {("f1", "f1"), ("f2", "f1"), ("f3", "f1"), ("f4", "f4")}


def test_episodes_of_long_chains(spark):
    import random

    chain = list(range(300))
    random.Random(1).shuffle(chain)  # smallest findings don't lie at an end
    rows = [(f"a{k:03}", f"e{e}") for k in range(400) for e in (k, k + 1)] + [(f"b{x:03}", f"s{e}") for k, x in enumerate(chain) for e in (k, k + 1)] + [("c", "lone")]
    m = spark.createDataFrame(rows, "finding string, event_ref string")
    got = {r["finding"]: r["episode"] for r in D.episodes(m).collect()}
    assert got == {f: {"a": "a000", "b": "b000", "c": "c"}[f[0]] for f, _ in rows}


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 200_000_000), (3, "b", 5), (4, None, 7)], "id long, k string, ts long")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 6, "y"), ("b", 6, "z")], "k string, rts long, v string")
    assert {r["id"]: r["v"] for r in as_of_join(left, right, ["k"], "ts", "rts", ["v"]).collect()} == {1: "x", 2: "y", 3: None, 4: None}
    with pytest.raises(ValueError):
        reference_lookup(left, spark.createDataFrame([("a", 1), ("a", 2)], "k string, w int"), ["k"], ["w"])
    ioc = spark.createDataFrame([("https://Evil[.]example/", "url")], "indicator string, kind string")
    seen = spark.createDataFrame([(1, "evil.example"), (2, "good.example"), (3, None)], "id int, d string")
    assert ids(indicator_match(seen, "d", ioc)) == [1]
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(20)], "c long, p long")
    assert ancestors(chain, "c", "p").count() == 190 and ancestors(chain, "c", "p", 4).count() == 70
    long = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(None, 5), (7, None)], "c int, p int")
    assert ancestors(long.where("c = 0 or c > 0 or c is null"), "c", "p").where("node = 0").count() == 300
    ring = spark.createDataFrame([(k, (k + 1) % 5) for k in range(5)], "c int, p int")
    assert {(r["node"], r["ancestor"]) for r in ancestors(ring, "c", "p").collect()} == {(a, b) for a in range(5) for b in range(5)}
    runs = spark.createDataFrame([(k, k, f"r{k % 2}", "Erro", "a" if k != 59 else "b") for k in range(60)], "id long, ts long, run string, level string, code string")
    shapes = {r["shape"] for r in X.run_shapes(runs, "run", "code", 10).collect()}
    assert len(shapes) == 2 and all(x.startswith(">".join("a" * 10) + ">…") for x in shapes)


def test_shifts_within_a_context(spark):
    # 12 bins of 40 rows; one source of four, diluted in the whole, turns to another code in bin 6, and a new pattern comes up in bin 9
    rows = [(b * 40 + k, (b * 40 + k) * 1000, f"s{k % 4}", "i", "late" if b == 6 and k % 4 == 1 else "ok", "new" if b == 9 and k % 5 == 0 else "old") for b in range(12) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, ts long, source string, level string, code string, pattern string")
    assert all(X.shifts(df, o).count() == 0 for o in ("level", "code", "pattern"))
    got = {(r["kind"], tuple(r["context"].items()), r["outcome"], r["observed"], r["bin"], r["n"], r["here"]) for r in X.context_shifts(df, ["source"]).collect()}
    assert got == {("behavior_shift", (("source", "s1"),), "code", "late", 6, 10, 10), ("new_pattern", (), "pattern", "new", 9, 8, 40)}
    assert X.context_shifts(df.limit(0), ["source"]).count() == 0


def test_variants_of_cohorts(spark):
    rows = [("a", "h1", "x>y")] * 6 + [("a", "h2", "x>z")] * 3 + [("a", "h1", "x>z"), ("a", None, "x>y")] + [("b", "h1", "p>q")] * 8 + [("b", "h1", "p")]
    runs = spark.createDataFrame(rows, "source string, host string, shape string")
    assert X.variants(runs).count() == 0  # no shape is usual in all runs
    got = {tuple(r) for r in X.cohort_variants(runs, ["source"], common=0.6).collect()}
    assert got == {("a", "x>z", 4, "x>y", 7, 11), ("b", "p", 1, "p>q", 8, 9)}
    got = [tuple(r) for r in X.variant_contrasts(runs, ["source"], ["host"], common=0.6).collect()]
    assert got == [("a", "x>z", "host", "h2", 3, 3, 7, 1, 1, 1), ("a", "x>z", "host", "h1", 7, 1, 3, 3, 1, 2)]


def test_bridges_over_a_hot_key(spark):
    rows = [("s", 100 * (k % 50), f"a{k % 3}", "hot") for k in range(200)] + [("t", 3000 + k // 2, "hot", f"c{k % 2}") for k in range(40)]
    df = spark.createDataFrame(rows, "source string, ts long, k1 string, k2 string")
    want = {}
    for s1, t1, a, m in rows:
        for s2, t2, n, c in rows:
            if m == n and s1 != s2 and 0 <= t2 - t1 <= 2000:
                n, first = want.get((m, a, c), (0, t1))
                want[m, a, c] = (n + 1, min(first, t1))
    assert bridges(df, 2000).count() == 0
    assert {(r["mid"], r["from"], r["to"]): (r["n"], r["first"]) for r in bridges(df, 2000, None).collect()} == want
