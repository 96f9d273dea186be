"""Every query of the catalogue that has SQL gives the rows of that SQL; the others are tested where their operators are."""

import math

import duckdb
import pytest

from ledgerline.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=str)
    relation = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in relation.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in relation.fetchall()), key=str)
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert all(x == pytest.approx(y, abs=2e-4) if isinstance(x, float) and isinstance(y, (int, float)) else x == y for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["path", "local_burden", "rule", "level"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
