"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from choicegrid import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(str([round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    rows = frame.select(*columns).collect()
    if name not in catalog.oracle_sql():
        assert rows
        return
    wanted = duck.sql(catalog.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    assert plain(rows) == plain(duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalog.oracle_sql()[name]})").fetchall())
