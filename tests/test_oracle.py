"""Every core query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from keyflux import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query(spark, duck, name):
    a, b = q.queries()[name](spark, SF).toPandas(), duck.sql(q.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    key = lambda d: sorted(map(tuple, d[cols].astype(object).values.tolist()), key=repr)
    assert key(a) == key(b)


def test_no_core_module_imports_the_llm_subpackage():
    import re

    import keyflux

    for folder, _, files in os.walk(os.path.dirname(keyflux.__file__)):
        for f in files:
            if f.endswith(".py") and not folder.endswith("llm"):
                assert not re.search(r"import .*\bllm\b|from .*\bllm\b", open(os.path.join(folder, f)).read()), f
