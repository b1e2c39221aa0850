"""Every query of the engine against its SQL twin, row by row, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__
from plumbline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_and_sql_agree(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    made = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in made.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([plain(r[names.index(c)]) for c in sorted(names)]) for r in made.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want


def test_contract(spark):
    assert __spark_entry__.entry(spark).columns == ["pkg_id", "check_id", "status"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
