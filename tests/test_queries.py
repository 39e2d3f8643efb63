"""Every query with SQL against DuckDB on the smallest tables; the others must give rows."""

import collections
import math

import duckdb
import pytest

from locusframe.plans import queries as plans


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, small, duck, name):
    df = plans.QUERIES[name](spark, small)
    rows = [tuple(map(plain, r)) for r in df.select(sorted(df.columns)).collect()]
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    cursor = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert [columns[i] for i in order] == sorted(df.columns)
    want = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    assert collections.Counter(rows) == collections.Counter(want)
