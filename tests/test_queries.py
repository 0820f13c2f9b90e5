"""Every registered query against its SQL in DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from quarry import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name in registry.ORACLE_SQL:
        got = duck.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        assert rows == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in got.fetchall())
