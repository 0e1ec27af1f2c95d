import csv
import io

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.operators.rejects import FILE, FILE_NEXT, RECORDS, START, classes, file_records, load_delimited, tokenize
from logweave.sources.readers import DEFAULT_LEVELS


def plain(text, mark):
    """The fields by a character loop, or None."""
    out, at = [], 0
    while True:
        if text[at : at + 1] == '"':
            at += 1
            field = ""
            while True:
                end = text.find('"', at)
                if end < 0:
                    return None
                field += text[at:end]
                at = end + 1
                if text[at : at + 1] != '"':
                    break
                field += '"'
                at += 1
            if at < len(text) and text[at] != mark:
                return None
        else:
            end = text.find(mark, at)
            end = len(text) if end < 0 else end
            field, at = text[at:end], end
            if '"' in field:
                return None
        out.append(field)
        if at >= len(text):
            return out
        at += 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='";a\n é', max_size=14), min_size=1, max_size=9))
def test_tokenizer_against_a_character_loop(texts):
    assert tokenize(texts, ";")[0] == [plain(t, ";") for t in texts]


def test_long_records_cross_chunks():
    cells = ["x" * 1000, 'q"' * 600, "", "line\nbreak;" * 300]
    out = io.StringIO()
    csv.writer(out, delimiter=";", quoting=csv.QUOTE_ALL, lineterminator="").writerow(cells)
    fields, bad = tokenize([out.getvalue(), "a;b", out.getvalue() + '"'], ";")
    assert fields[0] == cells and fields[1] == ["a", "b"] and fields[2] is None and bad[2] >= 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet='";a\n', max_size=60), st.integers(1, 9))
def test_chunks_compose(text, size):
    state, after = START, []
    for x in classes(text, ";"):
        state = int(FILE_NEXT[state, x])
        after.append(state)
    assert FILE.states(classes(text, ";"), START, size).tolist() == after
    elements = FILE.elements(classes(text, ";"), size)
    assert FILE.maps[FILE.compose(elements.tolist())][START] == state
    assert FILE.starts(elements).tolist() == [START, *after[size - 1 :: size]][: len(elements)]


def test_monoid():
    for m in (FILE, RECORDS):
        assert len(m.maps) < 200 and all((m.maps[m.product[a, b]] == m.maps[b][m.maps[a]]).all() for a in range(len(m.maps)) for b in range(len(m.maps)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet='";a\n', max_size=40), min_size=1, max_size=5))
def test_fields_by_any_chunks(texts):
    want = tokenize(texts, ";", 10_000)
    for chunk in (1, 3, 17):
        got = tokenize(texts, ";", chunk)
        assert got[0] == want[0] and got[1].tolist() == want[1].tolist()


def test_records_across_blocks_of_files(spark):
    """The same records from 1, 3 and 17 blocks, quotes across their borders included, as by Python's reader."""
    import random

    rng = random.Random(9)
    files = {}
    for name in ("a", "b"):
        out = io.StringIO()
        rows = [[rng.choice(["x", "", 'say "y"', "two\nlines", "p;q", "three\n\nof;it", "long " * 9]) for _ in range(3)] for _ in range(60)]
        csv.writer(out, delimiter=";", lineterminator="\n").writerows(rows)
        files[name] = (out.getvalue().split("\n")[:-1], rows)
    files["bad"] = (['1;"open', "2;x", "3"], None)
    for blocks in (1, 3, 17):
        # a block is named by its first line here, by its first byte in files
        made = [(name, -(-(k * blocks // len(lines)) * len(lines) // blocks), k, x, ";") for name, (lines, _) in files.items() for k, x in enumerate(lines)]
        parts = {}
        for r in made:
            parts.setdefault(r[:2], []).append(r)
        rdd = spark.sparkContext.parallelize(list(parts.values()), len(parts)).flatMap(lambda p: p)
        got = file_records(spark.createDataFrame(rdd, "part_path string, block long, line_no long, line string, delimiter string")).collect()
        for name, (_, rows) in files.items():
            mine = sorted((r for r in got if r["part_path"] == name), key=lambda r: r["line_no"])
            if rows:
                assert [r["cells"] for r in mine] == rows
            else:
                assert [(r["raw"], r["cells"]) for r in mine] == [('1;"open\n2;x\n3', None)] and mine[0]["error_at"] == len(mine[0]["raw"])
    assert file_records(spark.createDataFrame([], "part_path string, block long, line_no long, line string, delimiter string")).count() == 0


def test_reasons(spark):
    origin = spark.createDataFrame([("a.csv", ";", "Data;Hora;Nivel;Msg;Bytes", True), ("i.csv", "\t", "d\th\tn\tm\tb", None), ("x.csv", None, None, None)], "part_file string, delimiter string, header string, day_first boolean")
    cases = {
        "01/02/2025;23:59:59;Erro;tudo;12": None, '01/02/2025;00:00:00;ERROR;"a;b\n""c""";': None, '01/02/2025;00:00:00;erro;a"b;1': "quoting", '01/02/2025;00:00:00;erro;"a;1': "quoting",
        '01/02/2025;00:00:00;erro;"a" b;1': "quoting", "01/02/2025;00:00:00;erro;a": "columns", "": "columns", "31/02/2025;00:00:00;erro;a;1": "value", "1/2/25;00:00:00;erro;a;1": "value", "02/13/2025;00:00:00;erro;a;1": "value",
        "01/02/2025;24:00:00;erro;a;1": "value", "01/02/2025;0:00:00;erro;a;1": "value", "01/02/2025;00:00:00;grave;a;1": "value", "01/02/2025;00:00:00;erro;a;1.5": "value", "01/02/2025;00:00:00;erro;a;٣": "value", ";00:00:00;erro;a;1": "value",
    }
    rows = [(k, "a.csv", t, "clash") for k, t in enumerate(cases)] + [(90, "i.csv", "2025-01-31\t10:00:00\tinfo\tm\t", ""), (91, "i.csv", "01/01/2025\t10:00:00\tinfo\tm\t", ""), (92, "x.csv", "a", ""), (93, None, None, ""), (94, "a.csv", None, "")]
    df = spark.createDataFrame(rows, "id int, part_file string, raw string, load string").drop("load").withColumn("reason", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    got = {r["id"]: r for r in load_delimited(df, origin, DEFAULT_LEVELS).select("id", "load.*").collect()}
    assert [got[k]["reason"] for k in range(len(cases))] == list(cases.values())
    assert got[1]["fields"][3] == 'a;b\n"c"' and got[2]["error_at"] == 26
    assert [got[k]["reason"] for k in (90, 91, 92, 93, 94)] == [None, "value", "origin", "origin", "columns"]
    assert load_delimited(df.limit(0), origin, DEFAULT_LEVELS).count() == 0
