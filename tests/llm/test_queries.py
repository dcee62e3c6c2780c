"""The subpackage's queries: those with SQL against it, all of them over whole tables."""

import oracle
import pytest

from sizelake.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLE:
        assert oracle.difference(df, oracle.views(FOLDER), ORACLE[name]) == ""
    else:
        assert df.count() > 0
