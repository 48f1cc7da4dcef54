"""The driver contract."""

from __future__ import annotations

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and len(df.columns) > 1


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_llm_package():
    import ast
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "foliant"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import | ast.ImportFrom) else []
            module = getattr(node, "module", None) or ""
            assert "llm" not in module.split(".") and not any("llm" in n.split(".") for n in names), path
