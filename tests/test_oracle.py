"""Every registered query against its DuckDB twin on the smallest scale factor."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from routelake.plans.registry import load_all

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SQL = E.oracle_sql()


def _norm(v):
    if v is None:
        return "\x00"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{round(f, 6):.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql_twin(spark, sf_dir, con, name):
    df = E.queries()[name](spark, sf_dir)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(srows, scols) == _digest(drows, dcols)


def test_every_query_has_a_sql_twin():
    """Of the library itself; the operators that the entry module may add keep their own rule."""
    queries, sql = load_all()
    assert set(queries) == set(sql)
    assert set(E.queries()) >= set(queries) and set(SQL) >= set(sql)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["request_id", "tenant", "service", "env", "version", "url", "status_code"]
    assert df.count() > 0
