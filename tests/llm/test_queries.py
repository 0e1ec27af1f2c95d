"""Every query of the subpackage runs on the smallest tables; those with SQL give the same rows as it."""

import pytest

from logweave.llm import queries
from tests.compare import rows, views


@pytest.fixture(scope="module")
def con(folder):
    return views(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folder, con, name):
    got = queries.QUERIES[name](spark, folder).toPandas()
    assert len(got)
    if name in queries.ORACLE:
        want = con.execute(queries.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    if name.endswith("_found"):
        assert not got.isna().any().any() and not got.duplicated().any()


def test_found_columns(spark, folder):
    want = {"p1_found": ["v"], "p4_found": ["tab", "first_id", "copy_id"], "p5_found": ["id", "field", "restored"], "p7_found": ["lo_id", "hi_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, folder).columns == columns
