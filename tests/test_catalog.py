"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

from loomgraph import catalog, catalog_more, catalog_tables, catalog_text, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted([plain(r[names.index(c)]) for c in cols] for r in found.fetchall())
    assert sorted([plain(r[c]) for c in cols] for r in df.collect()) == want
