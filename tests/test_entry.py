from __future__ import annotations

import builtins
import sys

import pytest

import __spark_entry__ as entry_point
from gleanframe.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_flagship_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = entry_point.queries()[name](spark, SF)
    if name not in catalogue.SQL:
        assert got.count() > 0
        return
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = c.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    show = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert sorted(names) == sorted(got.columns)
    assert show(found.fetchall()) == show(map(tuple, got.select(*names).collect()))


def test_entry_works_without_the_llm_folders(monkeypatch):
    real = builtins.__import__

    def without(name, *args, **kw):
        if name.startswith("gleanframe.llm") or name == "corpus_pipeline" or (name == "gleanframe" and args and "llm" in str(args)):
            raise ImportError(name)
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", without)
    for m in [m for m in sys.modules if m.startswith("gleanframe.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    assert set(entry_point.queries()) == set(catalogue.QUERIES) and set(entry_point.oracle_sql()) == set(catalogue.SQL)
