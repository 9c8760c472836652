import os

import pytest

from kmerloom.llm import registries
from tests.compare import duck, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"
QUERIES = {n: (f, r.sql.get(n)) for r in registries() for n, f in r.queries.items()}


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    f, sql = QUERIES[name]
    df = f(spark, SF)
    rows = rows_of_spark(df)
    if sql:
        names, want = rows_of_sql(duck(SF), sql)
        assert names == sorted(df.columns) and rows == want
