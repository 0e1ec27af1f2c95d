import gzip
import io
import json
import tarfile
import zipfile

from pyspark.sql import functions as F

from logweave.sources import readers, sinks
from logweave.sources.detect import decode, detect


def write(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def rows(df):
    return [r.asDict() for r in df.orderBy("id").collect()]


def test_detect():
    cases = {
        '{"a":1}\n{"a":2}\n': "jsonl", '[{"a":1}]': "json", '{"Records":[{"a":1}]}': "json", "a;b\n1;2\n3;4\n": "csv-semicolon", "a,b\n1,2\n": "csv", "a\tb\n1\t2\n": "tsv", "#Version: 1.0\n#Fields: date time\n2024-01-01 00:00:00\n": "w3c",
        "#separator x\n#fields\tts\tuid\n1\t2\n": "zeek", "CEF:0|a|b|c|d|e|5|x=1\n": "cef", "<Events><Event/></Events>": "xml", "Oct 25 11:36:11 h p[1]: x\nOct 25 11:36:12 h p[1]: y\n": "mixed", "nothing here\nat all\n": "text", "": "text",
    }
    for text, want in cases.items():
        assert detect(text.encode()) == want, text
    assert detect(gzip.compress(b"x")) == "gzip" and decode("é".encode("cp1252")) == "é" and decode("é".encode("utf-16")) == "é"


def test_jsonl(spark, tmp_path):
    path = write(tmp_path, "a.jsonl", '{"@timestamp":"2024-01-02T03:04:05Z","level":"SEVERE","service":"s","message":"m","a":{"b":[1,2],"c":null},"n":9007199254740993}\nnot json\n\n{"timestamp":0}\n')
    got = rows(readers.read(spark, path))
    assert [r["parse_status"] for r in got] == ["parsed", "unparsed", "parsed"]
    assert got[0]["ts"] == 1704164645000 and got[0]["level"] == "Erro" and got[0]["source"] == "s" and got[0]["fields"]["a.b"] == "[1, 2]" and got[0]["fields"]["n"] == "9007199254740993"


def test_json_envelopes(spark, tmp_path):
    path = write(tmp_path, "e.json", json.dumps({"Records": [{"eventTime": "x", "message": "one"}, {"message": "two"}]}))
    assert [r["message"] for r in rows(readers.read(spark, path, "json"))] == ["one", "two"]
    assert readers.records_of({"hits": {"hits": [{"_source": {"a": 1}}]}}) == [{"a": 1}] and readers.records_of([[1], 2]) == [1, 2] and readers.records_of({"x": 1}) == [{"x": 1}]


def test_delimited(spark, tmp_path):
    path = write(tmp_path, "t.csv", 'Data;Hora;Nível;Origem;Mensagem\n02/01/2024;03:04:05;Erro;app;"a;b\nc ""q"""\n03/01/2024;00:00:00;info;;\n')
    got = rows(readers.read(spark, path, "csv-semicolon", zone="Europe/Madrid"))
    assert got[0]["ts"] == 1704161045000 and got[0]["message"] == 'a;b\nc "q"' and got[0]["level"] == "Erro" and got[1]["level"] == "Informação"


def test_headed_logs(spark, tmp_path):
    path = write(tmp_path, "w.log", "#Software: x\n#Fields: date time c-ip sc-status\n2024-01-02 03:04:05 1.2.3.4 200\n#Fields: date time sc-status\n2024-01-02 03:04:06 404\n")
    got = rows(readers.read(spark, path))
    assert [r["fields"].get("sc-status") for r in got] == ["200", "404"] and got[1]["ts"] == 1704164646000
    path = write(tmp_path, "z.log", "#separator \\x09\n#fields\tts\tuid\n1704164645.5\tC1\n1704164646.5\t-\n")
    assert [r["ts"] for r in rows(readers.read(spark, path))] == [1704164645500, 1704164646500]


def test_program_logs(spark, tmp_path):
    path = write(tmp_path, "p.log", "2024-01-02 03:04:05,678 ERROR [main] a.B - bad\njava.io.X: y\n\tat a.B.c(B.java:1)\nOct  7 01:02:03 h sshd[1]: error: no\n")
    got = rows(readers.read(spark, path, year=2024))
    assert [(r["level"], r["source"]) for r in got] == [("Erro", "a.B"), ("Erro", "sshd")] and got[0]["message"].count("\n") == 2


def test_single_line_formats(spark, tmp_path):
    path = write(tmp_path, "c.log", "CEF:0|V|P|1|7|worm|9|src=1.1.1.1 msg=hello there\n")
    got = rows(readers.read(spark, path))[0]
    assert got["message"] == "hello there" and got["fields"]["vendor"] == "V"
    path = write(tmp_path, "f.log", "Oct  7 01:02:03 fw kernel: IN=eth0 OUT= SRC=1.1.1.1 DST=2.2.2.2 PROTO=TCP\n")
    assert rows(readers.read(spark, path, "firewall"))[0]["fields"]["dst"] == "2.2.2.2"
    path = write(tmp_path, "r.log", "[7] bad: thing\nother\n")
    assert rows(readers.read_pattern(spark, path, r"^\[(?P<code>\d+)\] (?<level>\w+): (?<message>.*)$"))[0]["code"] == "7"


def test_xml_and_sheets(spark, tmp_path):
    path = write(tmp_path, "e.xml", '<Events><Event xmlns="x"><System><EventID>4688</EventID><TimeCreated SystemTime="2024-01-02T03:04:05Z"/><Computer>pc</Computer></System><EventData><Data Name="User">ana</Data></EventData></Event></Events>')
    got = rows(readers.read(spark, path))[0]
    assert (got["code"], got["ts"], got["fields"]["User"]) == ("4688", 1704164645000, "ana")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>message</t></si><si><t>hello</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>code</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    path = write(tmp_path, "s.xlsx", out.getvalue())
    assert [(r["message"], r["code"]) for r in rows(readers.read(spark, path))] == [("hello", "7")]


def test_archives(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("d/a.log.gz", gzip.compress("um\ndois\n".encode("cp1252")))
        inner = io.BytesIO()
        with tarfile.open(fileobj=inner, mode="w") as t:
            info = tarfile.TarInfo("b.txt")
            info.size = 4
            t.addfile(info, io.BytesIO(b"tres"))
        z.writestr("x.tar", inner.getvalue())
    path = write(tmp_path, "p.zip", out.getvalue())
    got = {(r["part_path"].rsplit("/p.zip", 1)[1], r["line_no"], r["line"]) for r in readers.read_archive_lines(spark, path).collect()}
    assert got == {("!/d/a.log.gz", 0, "um"), ("!/d/a.log.gz", 1, "dois"), ("!/x.tar!/b.txt", 0, "tres")}


def test_files_of_one_name_and_mixed_folders(spark, tmp_path):
    """Every file by its own format, header and encoding; same-named files stay apart; archives and compressed files read like others."""
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "b c").mkdir()
    log = "2024-01-02 03:04:05,678 ERROR [main] a.B - bad\njava.io.X: y\n2024-01-02 03:04:06,000 INFO [main] a.B - good\nmore\n"
    write(tmp_path, "in/a/app.log", log)
    write(tmp_path, "in/b c/app.log", log)
    write(tmp_path, "in/a/t.csv", "user,bytes\nana,1\nbob,2\n")
    write(tmp_path, "in/b c/t.csv", "bytes,user\n3,eva\n")
    write(tmp_path, "in/a/p.csv", 'report of today\n\nData;Nível;Mensagem\n02/01/2024;Erro;"x;\ny"\n03/01/2024;info;"broken\n')
    write(tmp_path, "in/a/n.tsv", "1\tx\t2024-01-02\n2\ty\t2024-01-03\n")
    write(tmp_path, "in/a/one.jsonl", '{"message":"only","level":"warn"}\n')
    write(tmp_path, "in/a/u.jsonl", '{"message":"ção"}\n{"message":"two"}\n'.encode("utf-16"))
    write(tmp_path, "in/a/w.txt", "nothing at all but words\nConfiguração\n".encode("cp1252"))
    write(tmp_path, "in/a/d.txt", "just some words\nConfiguração\n".encode("cp850"))
    write(tmp_path, "in/a/m.log", "one more\nplain line\n".encode() + "não\n".encode("cp1252") + "não\n".encode())
    write(tmp_path, "in/a/odd-name", gzip.compress(b'{"message":"zipped"}\n'))
    write(tmp_path, "in/a/h.log.gz", gzip.compress(b'{"message":"zipped too"}\n'))
    write(tmp_path, "in/a/e.xml", "<Events><Event><System><EventID>1</EventID></System></Event>\n<Event><System><EventID>2</EventID></System></Event></Events>")
    write(tmp_path, "in/a/r.json", json.dumps({"Records": [{"message": "r1"}, {"message": "r2"}]}))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.csv", "a;b\n1;2\n3;4\n")
        z.writestr("y.json", '[{"message":"z"}]')
        z.writestr("app.log", log)
    write(tmp_path, "in/a/z.zip", out.getvalue())
    got = rows(readers.read(spark, str(tmp_path / "in")))
    by = lambda name: sorted(((r["id"], r) for r in got if r["part_file"] == name or f"/{name}:" in r["event_ref"]), key=lambda x: (x[1]["event_ref"], x[0]))
    logs = [r for _, r in by("app.log")]
    assert len(logs) == 6 and len({r["event_ref"] for r in logs}) == 6 and sum(r["level"] == "Erro" for r in logs) == 3
    assert sorted((r["fields"]["user"], r["fields"]["bytes"]) for _, r in by("t.csv")) == [("ana", "1"), ("bob", "2"), ("eva", "3")]
    assert [(r["message"], r["level"], r["parse_status"]) for _, r in by("p.csv")][0] == ("x;\ny", "Erro", "parsed") and [r["parse_status"] for _, r in by("p.csv")] == ["parsed", "quoting"]
    assert [r["fields"]["coluna 2"] for _, r in by("n.tsv")] == ["x", "y"]
    assert [r["message"] for _, r in by("one.jsonl")] == ["only"] and [r["message"] for _, r in by("u.jsonl")] == ["ção", "two"]
    assert [r["message"] for _, r in by("w.txt")][1] == [r["message"] for _, r in by("d.txt")][1] == "Configuração" and [r["message"] for _, r in by("m.log")][2:] == ["não", "não"]
    assert [r["message"] for _, r in by("odd-name")] == ["zipped"] and [r["message"] for _, r in by("h.log.gz")] == ["zipped too"]
    assert [r["code"] for _, r in by("e.xml")] == ["1", "2"] and [r["message"] for _, r in by("r.json")] == ["r1", "r2"]
    assert [r["fields"] for _, r in by("z.zip!/x.csv")] == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}] and [r["message"] for _, r in by("z.zip!/y.json")] == ["z"]


def test_line_numbers_rise_over_blocks(spark, tmp_path):
    """Files of several blocks, packed with others: every line once, numbers unique and in order."""
    for k in range(5):
        write(tmp_path, f"f{k}.txt", "".join(f"{k} line {j}\n" * (1 + j % 3) for j in range(400 * (k + 1))) + "\n" * 300)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        got = readers.read_lines(spark, str(tmp_path)).collect()
        for k in range(5):
            mine = sorted((r["line_no"], r["line"]) for r in got if r["part_file"] == f"f{k}.txt")
            assert len({n for n, _ in mine}) == len(mine) and [x for _, x in mine] == (tmp_path / f"f{k}.txt").read_text().splitlines()
            assert len({r["block"] for r in got if r["part_file"] == f"f{k}.txt"}) > 1
        table = "id;text\n" + "".join(f'{j};"line\n{j} ""q"";"\n' for j in range(2000))
        (tmp_path / "t").mkdir()
        write(tmp_path, "t/big.csv", table)
        ev = readers.read(spark, str(tmp_path / "t"))
        assert ev.count() == 2000 and ev.where("parse_status <> 'parsed'").count() == 0
        assert {r["fields"]["text"] for r in ev.collect()} == {f'line\n{j} "q";' for j in range(2000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_other_families(spark, tmp_path):
    cases = {
        "logcat.log": ("10-25 11:36:11.123  1234  5678 E ActivityManager: gone\n10-25 11:36:12.000  1234  5678 I Wifi: up\n", [("Erro", "ActivityManager"), ("Informação", "Wifi")]),
        "squid.log": ("1286536308.779    180 192.168.0.224 TCP_MISS/200 411 GET http://x.test/ - DIRECT/1.2.3.4 text/html\n", [(None, None)]),
        "alb.log": ('https 2018-07-02T22:23:00.186641Z app/my-lb/50dc 192.168.131.39:2817 10.0.0.1:80 0.086 200 200 0 57 "GET https://x.test:443/ HTTP/1.1"\n', [(None, "app/my-lb/50dc")]),
        "own.log": ("2024.01.02 03:04:05 | WARN | worker-7: disk is full\n    at 91 %\n[02/01/2024 03:04:06] error db.pool: no connection\n", [("Aviso", "worker-7"), ("Erro", "db.pool")]),
    }
    for name, (text, want) in cases.items():
        got = rows(readers.read(spark, write(tmp_path, name, text)))
        assert [(r["level"], r["source"]) for r in got] == want, name
        assert name == "logcat.log" or all(r["ts"] for r in got)
    got = rows(readers.read(spark, write(tmp_path, "scan.gnmap", "# Nmap 7 scan\nHost: 10.0.0.5 (a.test)\tStatus: Up\nHost: 10.0.0.5 (a.test)\tPorts: 22/open/tcp//ssh///\tIgnored State: closed (99)\n")))
    assert got[1]["fields"]["label.status"] == "Up" and got[2]["fields"]["label.ignored_state"] == "closed (99)" and got[2]["fields"]["host"] == "10.0.0.5"
    got = rows(readers.read(spark, write(tmp_path, "ct.jsonl", '{"eventSource":"s3.x","eventName":"Put","eventTime":"2024-01-02T03:04:05Z"}\n{"auditID":"1","verb":"get","requestURI":"/a","user":{"username":"u"},"requestReceivedTimestamp":"2024-01-02T03:04:05Z"}\n')))
    assert [(r["fields"]["product"], r["code"], r["source"]) for r in got] == [("cloudtrail", "Put", "s3.x"), ("kubernetes", "get", "u")] and got[0]["ts"] == 1704164645000


def test_sinks(spark, tmp_path):
    path = write(tmp_path, "a.jsonl", '{"timestamp":"2024-01-02T03:04:05Z","message":"mail ana@x.test from 1.2.3.4","password":"p"}\n{"message":"other"}\n')
    ev = readers.read(spark, path)
    m = rows(sinks.masked(ev))[0]
    assert m["message"] == "mail ‹mail› from ‹ip›" and m["fields"]["password"] == "‹secret›"
    sinks.export(ev, str(tmp_path / "o"), mask=True)
    assert spark.read.json(str(tmp_path / "o")).count() == 2
    sinks.split(ev, F.col("message").contains("mail"), str(tmp_path / "m"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "m")).count() == spark.read.text(str(tmp_path / "r")).count() == 1
    sinks.store(ev, str(tmp_path / "st"))
    assert spark.read.parquet(str(tmp_path / "st")).where("day = '2024-01-02'").count() == 1
    assert sinks.source_quality(ev).first()["undated"] == 1
    both = readers.read_many(spark, [path, path])
    assert both.count() == both.select("id").distinct().count() == 4
