"""Every query that has SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import os

import duckdb
import pytest

from plumbline.plans import io_queries  # noqa: F401  registers its queries
from plumbline.plans import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: None if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted([tuple(show(r[k]) for k in order) for r in rows], key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_same_rows(spark, duck, name):
    df = engine.QUERIES[name](spark, DATA)
    found = duck.execute(engine.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), names)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_rows(spark, name):
    assert engine.QUERIES[name](spark, DATA).count() > 0
