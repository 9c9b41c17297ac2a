"""Every query with SQL against DuckDB, cell by cell."""

import math

import duckdb
import pytest

from corpusloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cells(table):
    names = sorted(table.column_names)

    def one(x):
        return "~" if x is None else ("nan" if math.isnan(x) else repr(round(x, 5) + 0.0)) if isinstance(x, float) else str(x)

    return names, sorted(zip(*(list(map(one, table.column(n).to_pylist())) for n in names), strict=True))


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_against_duckdb(name, spark, duck, sf_dir):
    ours = catalogue.QUERIES[name](spark, sf_dir).toArrow()
    theirs = duck.execute(catalogue.ORACLES[name]).to_arrow_table()
    assert cells(ours) == cells(theirs)
    kinds = lambda t: {f.name: str(f.type).replace("large_", "") for f in t.schema}
    a, b = kinds(ours), kinds(theirs)
    numeric = ("int8", "int16", "int32", "int64", "hugeint", "decimal")
    assert all(a[c] == b[c] or (a[c].startswith(numeric) and b[c].startswith(numeric)) for c in a), (a, b)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
