"""Every query with SQL returns the rows that DuckDB returns; the others return rows of a stable schema."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.registry import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
ENTRY_ROWS = 42  # months with a holding and two bars after it


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal_to_sql(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    cur = con.execute(ORACLE_SQL[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got = rows_of(df.columns, df.collect())
    assert got[0] == want[0] and got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, name):
    """Queries that SQL cannot express give rows of their columns; what they should say is tested in test_operators."""
    df = QUERIES[name](spark, str(DATA))
    assert df.columns and df.count() >= (0 if name == "lsh_pairs" else 1)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == ENTRY_ROWS and df.columns == ["month", "n_held", "port_ret"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_llm_subpackage():
    root = Path(__file__).resolve().parents[1]
    for p in (root / "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tidemark.llm" not in p.read_text() and "import llm" not in p.read_text(), p
