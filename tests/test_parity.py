"""Nulls, empty and awkward inputs of units, paths, memberships, transforms, learned scores and user rules."""

import json

import pytest
from pyspark.sql import functions as F

from logweave.events import column_of
from logweave.functions import transforms as T
from logweave.operators import aggregates as A
from logweave.operators import behavior as B
from logweave.operators import learning as L
from logweave.operators import roles, rules
from logweave.operators.aggregates import Measure as M
from logweave.plans import console
from logweave.plans.filters import Filter, apply
from logweave.plans.language import search

SCHEMA = "id long, ts long, source string, level string, code string, message string, size string, fields map<string,string>"
ROWS = [
    (1, 1000, "a", "Erro", "x", "one 1 two", "10 MB", {"Doc": '{"tags": ["p", "q"], "a": {"d": {"e": 5}}}', "User": "ana"}), (2, None, "a", None, None, None, None, None), (3, 3000, None, "Erro", "x", "", "5 ms", {"Doc": "no json"}),
    (4, 3000, "b", "Aviso", "y", "three 2 two", "7", {}), (4, 3000, "b", "Aviso", "y", "three 2 two", "7", {}),
]


@pytest.fixture(scope="module")
def ev(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_units(ev):
    assert A.dominant_unit(ev, "size") == 0 and A.dominant_unit(ev, "size", 2) == 1 and A.dominant_unit(ev.limit(0), "size") is None and A.dominant_unit(ev, "nowhere") is None
    got = {r["key"]: (r["sum_size"], r["sum_size_mixed"]) for r in A.aggregate(ev, [], "source", [M("count"), M("sum", "size")], one_unit=True).collect()}
    assert got == {"a": (None, True), None: (None, True), "b": (14.0, False)}
    got = A.aggregate(ev, [], "source", [M("string_agg", "code", "c"), M("max", "ts", "last")]).where("key = 'a'").first()
    assert (got["c"], got["last"]) == ("x", "1970-01-01T00:00:01.000Z")
    assert A.aggregate(ev.limit(0), [], "source", [M("count")], by_key=True).count() == 0


def test_snapshot_series_and_pivot(ev):
    assert A.explore(ev.limit(0), []).collect()[0]["n"] == 0
    dense = A.series(ev.where("source is not null"), "time", split="source", interval_ms=1000).collect()
    assert sorted((r["start"], r["split"], r["value"]) for r in dense) == [(1000, "a", 1.0), (1000, "b", 0.0), (2000, "a", 0.0), (2000, "b", 0.0), (3000, "a", 0.0), (3000, "b", 2.0)]
    with pytest.raises(ValueError):
        A.series(ev, "time", interval_ms=1, most=100)
    assert A.series(ev.limit(0), "time").count() == 0
    whole = {(r["path"], r["col"]): (r["count"], r["c"]) for r in A.pivot(ev, [], "source", [M("count"), M("string_agg", "code", "c")], 1).collect()}
    assert whole["", "(total)"] == (5, "x, x, y, y") and set(c for _, c in whole) == {"(total)", "(other)", "b"} or set(c for _, c in whole) == {"(total)", "(other)", "a"}


def test_paths(ev):
    got = ev.select("id", column_of(ev, "Doc.tags.1").alias("t"), column_of(ev, "Doc.a.d.e").alias("e"), column_of(ev, "user").alias("u"), column_of(ev, "SOURCE").alias("s")).distinct().orderBy("id").collect()
    assert [(r["t"], r["e"], r["u"], r["s"]) for r in got] == [("q", "5", "ana", "a"), (None,) * 3 + ("a",), (None,) * 4, (None,) * 3 + ("b",)]


def test_memberships(spark, ev):
    results = spark.createDataFrame([(1, "f1", "e1"), (1, "f1", "e1"), (4, "f2", "e1")], "id long, finding string, episode string")
    assert apply(ev, Filter("", "finding", "f1"), results=results).count() == 1 and apply(ev, Filter("", "episode", "e1"), Filter("level", "equals", "Aviso"), results=results).count() == 2
    for bad in (Filter("", "finding", "f1"), Filter("", "threat_rule", "nothing"), Filter("", "detection", "nothing")):
        with pytest.raises(ValueError):
            apply(ev, bad)
    text = spark.createDataFrame([(1, "GET /%2e%2e%2f%2e%2e%2fetc/passwd", None), (2, None, None), (3, "x", "")], "id long, message string, raw string")
    assert [r["id"] for r in search(text, "regra:traversal").collect()] == [1] and sorted(r["id"] for r in search(text, "NOT regra:traversal").collect()) == [2, 3]


def test_console_leaves_other_views(spark, ev):
    ev.limit(1).createOrReplaceTempView("events")
    assert console.execute(ev, "select count(*) as n from events").first()["n"] == 5 and spark.table("events").count() == 1
    spark.catalog.dropTempView("events")


def test_transforms(spark):
    deep = "<a>" * 20 + "</a>" * 20
    df = spark.createDataFrame([(1, '<a x="1"><b>t</b><b/>w</a>', {"t.a.b": "own"}), (2, None, None), (3, "<a", {}), (4, '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>', {}), (5, deep, {}), (6, "", {})], "id int, t string, fields map<string,string>")
    got = {r["id"]: r["j"] for r in df.select("id", T.parse_xml(F.col("t")).alias("j")).collect()}
    assert json.loads(got[1]) == {"a": {"@x": "1", "b": ["t", ""], "#text": "w"}} and all(got[k] is None for k in (2, 3, 4, 5, 6))
    got = {r["id"]: r["fields"] for r in T.exploded(df, "t", ["parse_xml"]).collect()}
    assert got[1] == {"t.a.b": "own", "t.a.@x": "1", "t.a.b.0": "t", "t.a.b.1": "", "t.a.#text": "w"} and got[2] == {} == got[6]
    one = lambda c: df.limit(1).select(c).first()[0]
    assert one(T.step(F.lit("Basic YTpi"), "basic")) == "a:b" and one(T.step(F.lit("aABpAA=="), "utf16_decode")) == "hi" and one(T.step(F.lit("eyJhIjoxfQ.x"), "jwt_header")) == '{"a":1}' and one(T.step(F.lit("Bearer x"), "basic")) is None
    assert one(T.delimited_fields(F.lit('1,"a,b"'), ["x", "y", "z"])) == {"x": "1", "y": "a,b"} and one(T.delimited_fields(F.lit(None).cast("string"), ["x"])) is None
    assert one(T.all_matches(F.lit("a1b22"), r"\d+")) == ["1", "22"]


def test_learned_scores_on_awkward_rows(ev):
    assert L.joint_novelty(ev, "source", "code", "level", 5, 1).count() == 3 and L.unexpected_failures(ev, "source", 1, 1.0).count() == 1
    assert L.sequence_surprise(ev, "source", "code", 1).count() == 1 and L.incidents(ev, "source", F.col("level") == "Aviso", least=2).first()["n"] == 2
    assert L.contrasts(ev, F.col("level") == "Erro", ["source", "code"]).count() == 0
    for f in (lambda d: L.joint_novelty(d, "source", "code", "level"), lambda d: L.sequence_surprise(d, "source", "code"), lambda d: L.incidents(d, "source", F.col("level") == "Erro"), lambda d: L.cluster_templates(d, "source"), lambda d: L.contrasts(d, F.lit(True), ["source"])):
        assert f(ev.limit(0)).count() == 0
    got = {(r["context"], r["template"], r["n"], r["members"]) for r in L.cluster_templates(ev.where("id in (1, 4)").withColumn("source", F.lit("s")), "source").collect()}
    assert got == {("s", "‹…› ‹…› two", 3, 2)} and sum(r["n"] for r in L.cluster_templates(ev, "source", 1).collect()) == 4


def test_takeover_needs_order_and_span(spark):
    rows = [(1, 10, "u", "a"), (2, 20, "u", "b"), (3, 30, "u", "c"), (4, 30, "u", "b"), (5, 40, "v", "a"), (6, 40, "v", "b"), (7, 50, "v", "c"), (8, 500, "u", "c"), (9, None, "u", "c"), (10, 60, None, "a")]
    df = spark.createDataFrame(rows, "id long, ts long, user string, action string")
    got = {(r["user"], r["first_id"], r["second_id"], r["third_id"]) for r in B.takeover_chain(df, ("a", "b", "c"), ["user"], 100).collect()}
    assert got == {("u", 1, 2, 3)}


def test_new_times_and_mappings(spark):
    rows = [(1, 5, "s1", None, "at 02/01/2024 03:04:05 x", "a.log", {"d": "3"}), (2, 5, "s2", None, None, None, None), (3, 5, None, None, "at 32/01/2024 03:04:05", "a.log", {"d": "n"})]
    df = spark.createDataFrame(rows, "id long, ts long, source string, message string, raw string, part_file string, fields map<string,string>")
    got = {r["id"]: r["ts"] for r in roles.retimestamp(df, [{"file": "a", "pattern": r"at (\S+ \S+)", "zone": "UTC"}]).collect()}
    assert got == {1: 1704164645000, 2: 5, 3: 5}
    got = {r["id"]: r["fields"] for r in roles.map_sources(df, [{"source": "^s", "fields": {"ms": {"from": "d", "factor": 1000.0}}}]).collect()}
    assert got == {1: {"d": "3", "ms": "3000.0"}, 2: {}, 3: {"d": "n"}}


def test_participants(spark):
    rows = [(1, 1, "s", "4625", None, "failed", None, {"src_ip": "9.9.9.9", "host": "h"}), (2, 2, "s", None, None, None, None, None), (3, 3, "s", None, None, "x", None, {"url": "/a?q=../../etc/passwd", "src_ip": "8.8.8.8"})]
    df = spark.createDataFrame(rows, "id long, ts long, source string, code string, level string, message string, raw string, fields map<string,string>")
    got = {r["id"]: r["participants"] and (r["participants"]["attacker"], r["participants"]["target"]) for r in roles.participants(df).collect()}
    assert got == {1: ("9.9.9.9", "h"), 2: None, 3: ("8.8.8.8", "/a")}
    assert rules.run_all(rules.flat(df.limit(0))).count() == 0


def test_locators():
    from logweave.operators.examples import Example, locators, verify

    texts = [("user=ana from 10.0.0.1 port 22", "10.0.0.1"), ("user=bob from 10.9.0.77 port 1", "10.9.0.77")]
    got = locators([Example(t, t.index(v), t.index(v) + len(v)) for t, v in texts])
    assert got and all(verify(p, [t for t, _ in texts]) == [v for _, v in texts] for p in got) and verify(got[0], ["x from 1.2.3.4 port 9", "nothing", None]) == ["1.2.3.4", None, None]
    assert locators([]) == [] and locators([Example("abc", 0, 3), Example("zz 9", 0, 4)]) == ["^(.+?)$"]
    with pytest.raises(ValueError):
        locators([Example("abc", 2, 2)])


def test_store_grows_by_new_files_and_indexes(spark, tmp_path):
    from logweave.sources import index

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"message":"m1","user":"ana"}\n{"message":"m2"}\n')
    store = str(tmp_path / "store")
    assert index.add_new_files(spark, str(tmp_path / "in"), store) == 1 and index.add_new_files(spark, str(tmp_path / "in"), store) == 0
    (tmp_path / "in" / "b.jsonl").write_text('{"message":"m3","user":"ana"}\n')
    (tmp_path / "in" / "a.jsonl").write_text('{"message":"m1","user":"ana"}\n{"message":"m2"}\n{"message":"m4"}\n')
    assert index.add_new_files(spark, str(tmp_path / "in"), store) == 2
    events = index.stored_events(spark, store)
    assert sorted(r["message"] for r in events.collect()) == ["m1", "m2", "m3", "m4"]
    numbered = events.withColumn("id", F.xxhash64("message"))
    index.index_field(numbered, "user", str(tmp_path / "i"))
    assert sorted(r["message"] for r in index.by_index(numbered, str(tmp_path / "i"), "ana").collect()) == ["m1", "m3"] and index.by_index(numbered, str(tmp_path / "i"), "Ana").count() == 0
    assert tuple(index.index_status(spark, str(tmp_path / "i")).first()) == (2, 1)
