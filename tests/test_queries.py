"""Every core query runs on the smallest tables; those with SQL give the same rows as it."""

import pytest

from logweave import registry
from tests.compare import rows, views


@pytest.fixture(scope="module")
def con(folder):
    return views(folder)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, folder, con, name):
    got = registry.QUERIES[name](spark, folder).toPandas()
    if name in registry.ORACLE:
        want = con.execute(registry.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_sql_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_core_does_not_import_llm():
    import subprocess
    import sys

    code = "import sys, logweave.registry; sys.exit(any(m.startswith('logweave.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_joins_hold_every_order(spark, folder, con, how):
    assert registry.QUERIES[f"join_{how}"](spark, folder).where("o_orderkey is not null").count() == con.execute("select count(*) from orders").fetchone()[0]


def test_string_agg_holds_every_event(spark, folder, con):
    assert registry.QUERIES["agg_string_agg"](spark, folder).agg({"count": "sum"}).first()[0] == con.execute("select count(*) from events").fetchone()[0]
