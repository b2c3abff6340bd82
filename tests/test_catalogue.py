"""Every query with a SQL twin, against DuckDB, over the smallest tables; the others must give rows."""

import ast
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from brindle.plans import catalogue, problems, tpch
from brindle.session import TABLES

PARTS = [tpch, catalogue, problems]
WITH_SQL = [(k, p) for p in PARTS for k in p.SQL]
WITHOUT = [(k, p) for p in PARTS for k in p.QUERIES if k not in p.SQL]


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    """As the values are compared: NaN equals nothing, and a negative zero is no zero."""
    if isinstance(v, float):
        return (v, math.copysign(1, v)) if v == 0 else v
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def order(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name, part", WITH_SQL, ids=[k for k, _ in WITH_SQL])
def test_against_sql(spark, data, duck, name, part):
    df = __spark_entry__.queries()[name](spark, data)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=order)
    rel = duck.execute(part.SQL[name])
    found = [c[0] for c in rel.description]
    assert sorted(found) == names
    want = sorted((tuple(plain(r[found.index(c)]) for c in names) for r in rel.fetchall()), key=order)
    assert got == want


@pytest.mark.parametrize("name, part", WITHOUT, ids=[k for k, _ in WITHOUT])
def test_gives_rows(spark, data, name, part):
    assert __spark_entry__.queries()[name](spark, data).count() > 0


def test_entry(spark, data):
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    root = Path(__spark_entry__.__file__).parent
    for p in (root / "brindle").rglob("*.py"):
        if "llm" not in p.relative_to(root / "brindle").parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any(n.startswith("brindle.llm") for n in names), p
