"""Every registered query of the reference's own operators against its SQL, over whole tables."""

import os

import pytest

from plumbline.plans import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return list(map(plain, value)) if isinstance(value, (list, tuple)) else value


def lines(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF_DIR)
    want = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert lines(got.columns, [tuple(r) for r in got.collect()]) == lines(names, want.fetchall())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)
