"""The driver's contract."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "driftquarry").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "driftquarry").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] + [getattr(node, "module", None) or ""] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
            assert not any("llm" in n.split(".") for n in names), path
