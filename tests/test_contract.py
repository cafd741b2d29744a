"""The driver contract holds with and without the optional subpackage and without a session."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def _run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)


def test_names_without_a_session():
    r = _run("import __spark_entry__ as e; q = e.queries(); assert 'degree_metrics' in q and set(e.oracle_sql()) <= set(q)")
    assert r.returncode == 0, r.stderr


def test_without_llm():
    r = _run("import sys; sys.modules['srcatlas.llm'] = None\nimport __spark_entry__ as e; assert 'p1_found' not in e.queries() and 'p5_found' in e.queries()")
    assert r.returncode == 0, r.stderr


def test_nothing_imports_llm():
    for p in (ROOT / "srcatlas").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p
