"""Each registered core query against its SQL on the smallest tables."""

import decimal
import os

import pytest

from turnmill.plans.core import CORE


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return str(int(v)) if v == int(v) else repr(round(v, 9))
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_equals_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    df = CORE.queries[name](spark, data)
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    r = c.execute(CORE.sql[name])
    columns = [d[0] for d in r.description]
    assert table(df.columns, [tuple(x) for x in df.collect()]) == table(columns, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(CORE.queries) - set(CORE.sql)))
def test_runs(spark, data, name):
    CORE.queries[name](spark, data).collect()


def test_scrubbed_documents_pass_the_gate(spark, data):
    assert CORE.queries["round_trip_law"](spark, data).count() == 0


def test_entry_without_the_subpackage(monkeypatch):
    import importlib

    import __spark_entry__ as e

    real = importlib.import_module

    def missing(name, *a):
        if ".llm" in name:
            raise ModuleNotFoundError(f"No module named {name}", name="turnmill.llm")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert set(e.queries()) == set(CORE.queries)


def test_too_many_terms_or_names_raise(spark):
    from turnmill.plans import core

    terms = spark.range(10_001).selectExpr("id as term_id", "concat('t', id) as term", "'abuse' as category", "1.0d as weight")
    names = spark.range(200_001).selectExpr("id as name_id", "concat('n', id) as name", "'given' as kind")
    for query, table in ((core.toxicity_ladder, terms), (core.ner_scrub_documents, names)):
        with pytest.raises(ValueError):
            query.__wrapped__(lambda _, x=table: x)
