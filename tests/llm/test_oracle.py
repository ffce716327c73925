import duckdb
import pytest

from kinscribe.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "sale_lines"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries()[name](spark, SF), c.execute(oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(x) for x in got.select(columns).collect()]
    assert sorted(rows, key=repr) == sorted(want.fetchall(), key=repr) and rows
