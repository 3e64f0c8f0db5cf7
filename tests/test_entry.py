import importlib
import sys


def test_entry_and_names(spark):
    import __spark_entry__ as e

    got = e.entry(spark)
    assert got.count() > 0 and got.columns == ["id", "title", "similarity", "score", "recency"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_llm_folder(monkeypatch):
    for name in [n for n in sys.modules if n.startswith(("strata.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "strata.llm" or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    e = importlib.import_module("__spark_entry__")
    assert e.llm is None and "hybrid_search" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
