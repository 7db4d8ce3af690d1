"""Every query of the core over the smallest tables: it runs, and where there is SQL the rows are the same."""

import math
from collections import Counter
from pathlib import Path

import pytest

from palaver.queries import MODULES, gather

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = gather(MODULES, "palaver")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")
#: Queries that may find nothing in so few rows.
SPARSE = {"exact_cache_hits", "semantic_rescue", "deal_signals", "evaluation_scores", "semantic_cache_documents"}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else int(v) if isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    rows = [{k: plain(v) for k, v in r.asDict(True).items()} for r in QUERIES[name](spark, str(DATA)).collect()]
    assert rows or name in SPARSE
    if name in SQL:
        cur = duck.execute(SQL[name])
        cols = [d[0] for d in cur.description]
        want = [dict(zip(cols, map(plain, r), strict=True)) for r in cur.fetchall()]
        assert Counter(tuple(sorted(r.items())) for r in rows) == Counter(tuple(sorted(r.items())) for r in want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
