"""Every query with an oracle returns the oracle's rows."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from folioforge import catalog  # noqa: E402
from folioforge.session import TABLES  # noqa: E402

REG = catalog.load_all()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(table, names):
    plain = [tuple(f"{v:.6f}" if isinstance(v, float) else v for v in (r[n] for n in names)) for r in table.to_pylist()]
    return sorted(plain, key=repr)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REG.items() if sql))
def test_same_rows(spark, duck, sf_dir, name):
    f, sql = REG[name]
    got, want = f(spark, sf_dir).toArrow(), duck.sql(sql).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names
    assert rows(got, names) == rows(want, names)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REG.items() if not sql))
def test_runs(spark, sf_dir, name):
    assert REG[name][0](spark, sf_dir).toArrow().num_rows > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
