"""Neighbours, running sums, distinct windows and percentiles against brute force, one key with most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import sliding
from logweave.operators.aggregates import percentiles
from logweave.operators.ordered import block_width, with_previous, with_running

rng = random.Random(12)
ROWS = [(k, rng.choice(["hot"] * 18 + ["cold", None]), rng.choice([None] + [rng.randint(0, 50_000)] * 30), rng.choice(["a", "b", "c", None, f"v{k}"]), rng.choice([None, k % 7, -1])) for k in range(1500)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, key string, ts long, value string, n long")


def groups():
    out = {}
    for r in sorted((r for r in ROWS if r[2] is not None), key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("width", [None, 1, 777, 10**9])
def test_previous_and_running(df, width):
    got = {r["id"]: (r["before"], r["was"], r["total"]) for r in with_running(with_previous(df, ["key"], {"ts": "before", "value": "was"}, width=width), ["key"], F.col("n"), "total", width=width).collect()}
    want = {}
    for rows in groups().values():
        last, total = (None, None), 0
        for i, _, ts, v, n in rows:
            total += n or 0
            want[i] = (*last, total)
            last = (ts, v)
    assert got == want


def test_a_hot_key_spreads(spark, df):
    """No block of the key that holds nine tenths of the rows has more than its share of the time."""
    width = block_width(df)
    sizes = [r["count"] for r in df.where("key = 'hot' and ts is not null").groupBy(F.floor(F.col("ts") / width)).count().collect()]
    assert len(sizes) >= 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) <= len(ROWS) / 8


@pytest.mark.parametrize("width", [0, 100, 5000])
def test_distinct_windows(df, width):
    got = {r["id"]: r["win_distinct"] for r in sliding.with_distinct(df.where("ts is not null"), ["key"], width, "value").collect()}
    want = {r[0]: len({x[3] for x in rows if x[3] is not None and r[2] - width <= x[2] <= r[2]}) for rows in groups().values() for r in rows}
    assert got == want


def test_percentiles(spark):
    rows = [("a", rng.choice([rng.uniform(-5, 5), 0.0, rng.uniform(1e12, 1e12 + 5), 10.0 ** rng.randint(-20, 20), -3.0])) for _ in range(400)] + [("b", 7.0)] * 30 + [("c", None), (None, 1.0), (None, 2.0)]
    ps = (0.0001, 0.25, 0.5, 0.95, 1.0)
    got = {r[0]: r[1:] for r in percentiles(spark.createDataFrame(rows, "g string, x double"), "x", "g", ps).collect()}
    for g in ("a", "b", None):
        xs = sorted(x for k, x in rows if k == g)
        want = [len(xs)] + [xs[max(1, -(-len(xs) * round(p * 10_000) // 10_000)) - 1] for p in ps]
        assert list(got[g]) == want, g
    assert "c" not in got


def test_jumps(spark):
    rows = [(1, "h", 10, 5), (2, "h", 20, 6), (3, "h", 30, 9), (4, "h", 40, 9), (5, "h", 50, 3), (6, "g", 5, 1), (7, "h", 60, None)]
    got = sliding.sequence_jumps(spark.createDataFrame(rows, "id long, key string, ts long, n int"), ["key"], "n").orderBy("id").collect()
    assert [(r["id"], r["before"], r["number"], r["missing"]) for r in got] == [(3, 6, 9, 2), (4, 9, 9, -1), (5, 9, 3, -7)]


@pytest.mark.parametrize("width", [1, 40, 900])
def test_islands(df, width):
    rows = sliding.with_sliding(df, ["key"], width)
    got = {(r["key"], r["first"], r["last"], r["hits"]) for r in sliding.islands(rows, ["key"], width, F.col("win_n") >= 2).collect()}
    want = set()
    for key, some in groups().items():
        times = [r[2] for r in some]
        hits = [t for t in times if sum(t - width <= x <= t for x in times) >= 2]
        runs: list[list[int]] = []
        for t in hits:
            if runs and t - runs[-1][-1] <= width:
                runs[-1].append(t)
            else:
                runs.append([t])
        want |= {(key, r[0], r[-1], len(r)) for r in runs}
    assert got == want
