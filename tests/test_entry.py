import builtins
import importlib
import math
import re
import sys

import duckdb
import pytest

import __spark_entry__
from veriglyph.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, duck, name):
    got = __spark_entry__.queries()[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if sql := __spark_entry__.oracle_sql().get(name):
        want = duck.execute(sql)
        assert table(got.columns, rows) == table([c[0] for c in want.description], want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_subpackage(monkeypatch):
    real = builtins.__import__

    def missing(name, globals=None, locals=None, fromlist=(), level=0):
        if name in ("veriglyph.llm", "corpus_pipeline") or name.startswith("veriglyph.llm."):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", missing)
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("veriglyph.llm")]:
        monkeypatch.delitem(sys.modules, name)
    try:
        fresh = importlib.reload(__spark_entry__)
        assert set(fresh.queries()) == set(queries.QUERIES) and set(fresh.oracle_sql()) == set(queries.ORACLES)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans(spark, sf):
    check = plan(queries.QUERIES["multi_source_check"](spark, sf))
    assert "BroadcastNestedLoopJoin" not in check and "CartesianProduct" not in check and "Python" not in check.replace("ArrowEvalPython", "Python", 0) or "ArrowEvalPython" in check
    docs = plan(queries.QUERIES["canonicalise_docs"](spark, sf))
    assert docs.count("ArrowEvalPython") <= 2 and "struct<doc_id:bigint,text:string>" in docs
    assert "ArrowEvalPython" not in plan(queries.QUERIES["is_clean_docs"](spark, sf))
    risk = plan(queries.QUERIES["risk_levels"](spark, sf))
    assert "CartesianProduct" not in risk and "BroadcastNestedLoopJoin" not in risk


def test_identifiers_are_not_joined_with_themselves(spark, sf):
    assert not re.search(r"keys \[\d\]: \[identifier", plan(queries.QUERIES["cross_script_customers"](spark, sf)))
