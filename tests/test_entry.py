"""Every query that has SQL gives the same rows as DuckDB on the smallest tables; the rest of the library does without its llm part."""

import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = entry.SMOKE
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(SMALL).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(float(v) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    rel = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    a = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    b = sorted(tuple(plain(dict(zip(cols, r))[c]) for c in order) for r in rel.fetchall())
    assert a == b


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_imports_llm():
    root = Path(entry.__file__).parent
    for p in (root / "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tidemark.llm" not in p.read_text(), p
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p9_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
