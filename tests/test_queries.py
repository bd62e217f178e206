"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tessella.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_gives_what_sql_gives(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    cur = duck.execute(registry.oracles()[name])
    kinds = {d[0]: str(d[1]) for d in cur.description}
    assert sorted(kinds) == cols
    assert {c: TYPES.get(t) for c, t in df.dtypes} == kinds
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(close(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_entry_without_the_optional_parts(spark, monkeypatch):
    import builtins
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("tessella.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name.startswith("tessella.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 16
    assert set(entry.queries()) == set(registry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_filters_and_columns_reach_the_scan(spark):
    df = registry.queries()["sparse_default"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_tax), GreaterThan(l_tax,0.05)" in plan
    assert "l_extendedprice" not in plan
