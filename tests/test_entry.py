import importlib
import re
import sys


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_queries_and_sql_agree_on_names():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert len(q) > 60 and set(s) <= set(q)


def test_core_does_not_import_llm(monkeypatch):
    import __spark_entry__ as e

    for k in [k for k in sys.modules if k.startswith("twinlens")]:
        monkeypatch.delitem(sys.modules, k)
    monkeypatch.setattr(e, "_llm", lambda: None)
    names = e.queries()
    assert not any(re.match(r"p\d+_", n) for n in names)
    assert not any(k.startswith("twinlens.llm") for k in sys.modules)
    importlib.invalidate_caches()
