"""The library stands without its llm subpackage, and nothing outside of it imports it."""

import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_no_import_of_llm():
    for p in (ROOT / "flipgraph").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_entry_without_llm():
    code = "import sys; sys.modules['flipgraph.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'g_psp_probe' in q and 'p3_found' in q and 'p4_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_runs(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["exp_id", "pivot", "cost"]
