"""Every query against its DuckDB SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from skyloom.plans import canonical, catalogue, enriching, identity, intake, merging, publish, publishing, review, service, sources  # noqa: F401 (all but the second register their queries)

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (int, float)):
        return f"{float(value):.4f}"
    return str(list(map(plain, value))) if isinstance(value, (list, tuple)) else str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalogue.ORACLES:
        cursor = duck.execute(catalogue.ORACLES[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert found == rows(names, cursor.fetchall())
    else:
        assert found
