import os

import duckdb
import pytest

import __spark_entry__ as entry
from framelake.plans import queries as plans
from framelake.plans import sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def base(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*' )" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _comparable(rows):
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_its_sql(spark, small, base, name):
    if name not in entry.oracle_sql():
        if name in plans.queries():
            assert plans.queries()[name](spark, small).count() > 0
        return
    got = entry.queries()[name](spark, small)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = base.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert _comparable(tuple(r) for r in got.select(*columns).collect()) == _comparable(want)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "mean_cer" in out.columns


def test_sql_names_are_queries():
    assert set(sql.SQL) <= set(plans.queries())
