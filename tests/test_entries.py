from pyspark.sql import functions as F

from logweave.operators.entries import frame_entries, parse_texts, with_standard_level
from logweave.operators.layouts import Router
from logweave.sources.readers import DEFAULT_LEVELS

SCHEMA = "part_file string, line_no long, record_id long, line string, part string, id long, stamp string"
LINES = [
    "2025-01-02 03:04:05,678 ERROR [main] a.b.C - it failed",
    "java.io.IOException: ERROR 42 while reading",
    "\tat a.b.C.step(C.java:1)",
    '1.2.3.4 - - [27/Oct/2024:02:53:59 +0200] "GET / HTTP/1.1" 200 5 "-" "x"',
    "{",
    '  "level": "WARN", "component": "x.Y",',
    '  "ts": 1729860851022,',
    '  "msg": "two"',
    "}",
    "Oct 25, 2024 6:55:16 AM p.Q run",
    "SEVERE: gone",
    "info: My.Web[2]",
    "      hello",
    "Oct 25 11:36:11 host prog[12]: [warn] w",
]


def frame(spark, rows, parts=1, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return frame_entries(df, DEFAULT_LEVELS, **how).toPandas().sort_values(["part", "first_line"], na_position="first").to_dict("records")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def table(lines, name="f"):
    return [(name, k, 100 + k, x, "clash", -1, "clash") for k, x in enumerate(lines)]


def test_entries_span_lines(spark):
    got = frame(spark, table(LINES))
    assert [(e["first_id"], e["last_id"], e["level"], e["component"]) for e in got] == [
        (100, 102, "ERROR", "a.b.C"), (103, 103, None, ""), (104, 108, "WARN", "x.Y"), (109, 110, "SEVERE", "p.Q"), (111, 112, "info", "My.Web"), (113, 113, "warn", "prog")]
    assert got[0]["message"].startswith("it failed\njava.io") and got[2]["message"] == "two" and got[2]["stamp"] == "1729860851022"


def test_partition_borders_do_not_matter(spark):
    lines = LINES * 9
    rows = table(lines) + table(lines[3:], "g")
    whole = frame(spark, rows, 1)
    for parts in (2, 7, 40):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert frame(spark, rows, parts) == whole
            short = frame(spark, rows, parts, keep_message=False)
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert [(e["first_id"], e["last_id"], e["level"], e["component"], e["stamp"]) for e in short] == [(e["first_id"], e["last_id"], e["level"], e["component"], e["stamp"]) for e in whole]


def test_repeated_rows_and_disorder(spark):
    rows = table(LINES)
    assert frame(spark, rows[::-1] + rows[2:9], 3) == frame(spark, rows)


def test_nulls_empty_and_headless(spark):
    assert frame(spark, []) == []
    got = frame(spark, [(None, 1, 1, None, "", 0, ""), (None, 2, 2, LINES[0], "", 0, ""), ("a", None, 3, "x", "", 0, ""), ("a", 1, None, "x", "", 0, ""), ("b", 1, 9, "just text", "", 0, "")])
    assert [(e["first_id"], e["layout"]) for e in got] == [(1, "none"), (2, "threaded"), (9, "none")]


def test_very_long_entry(spark):
    lines = [LINES[0]] + ["\tat x.Y.z(Y.java:7)"] * 20_000 + ["y" * 500_000, LINES[3]]
    got = frame(spark, table(lines), 3)
    assert [(e["first_id"], e["last_id"]) for e in got] == [(100, 20_101), (20_102, 20_102)] and len(got[0]["message"]) > 800_000


def test_texts(spark):
    rows = [(1, LINES[0]), (2, None), (3, ""), (4, '{"log":"Oct 25 11:36:11 h p[1]: error: x\\n","stream":"stderr"}'), (5, "\n".join(LINES[4:9])), (6, "nothing"), (7, "<187>1 2025-01-01T00:00:00Z h app 1 ID - m")]
    got = parse_texts(spark.createDataFrame(rows, "id int, text string"), DEFAULT_LEVELS).select("id", "entry.*")
    by = {r["id"]: r for r in got.collect()}
    assert by[1]["component"] == "a.b.C" and by[4]["level"] == "error" and by[5]["component"] == "x.Y"
    assert [by[k]["layout"] for k in (2, 3, 6)] == ["none"] * 3
    levels = {r["id"]: r["level"] for r in with_standard_level(got, DEFAULT_LEVELS).collect()}
    assert levels == {1: "Erro", 4: "Erro", 5: "Aviso", 7: "Erro"}
    assert with_standard_level(got, {}).count() == 0


def test_router_headers():
    r = Router(DEFAULT_LEVELS)
    assert r.header("") is None and r.header("SELECT 1") is None and r.header("WHERE nivel = 'ERROR'") is None
    assert r.header("2024/03/31 09:05:48 [trace] 743#1: *3 x").level == "trace"
    assert r.header("[Fri Oct 24 08:37:54.577419 2025] [headers:notice] [pid 1:tid 2] x").component == "headers"
    assert r.header("I1028 18:02:07.940000   31949 lease.go:545] x").component == "lease.go"
    assert r.header('n=1 at=2025-01-01T00:00:00Z module=fila lvl=debug msg="a b"').component == "fila"
    assert F is not None
