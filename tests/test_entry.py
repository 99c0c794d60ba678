"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_without_subpackage():
    code = "import sys; sys.modules['loomgraph.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'dir_rollup' in q and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for p in (REPO / "loomgraph").rglob("*.py"):
        if "llm" not in p.parts:
            assert "loomgraph.llm" not in p.read_text(), p
