"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from strataprobe.plans import captured, expressions, files, registry  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents labels pages benchmark conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in registry.SQL:
        assert rows
        return
    want = db.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert norm(rows, got.columns) == norm(want.fetchall(), names)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns


def test_matching_prunes_columns_and_pushes_filters(spark):
    plan = registry.assoc_semi(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_totalprice" not in plan and "BatchEvalPython" not in plan
