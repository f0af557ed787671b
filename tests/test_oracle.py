"""Every registered query against its DuckDB oracle (the driver's check, on the smallest landed scale)."""

import pytest
from compare import compare, duck
from conftest import SF_SMALL

from kbspark.oracle import ORACLE
from kbspark.queries import QUERIES

_con = None


def con():
    global _con
    if _con is None:
        _con = duck(SF_SMALL)
    return _con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    r = compare(QUERIES[name](spark, SF_SMALL), con(), ORACLE[name])
    assert r["cols_equal"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_equal"], r


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only == {"retrieve_by_text", "topk_ivf"}
    assert set(ORACLE) <= set(QUERIES)


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert [f.name for f in df.schema] == ["qid", "id", "score", "path", "prompt", "error"]
