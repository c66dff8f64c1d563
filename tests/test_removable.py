"""The library without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = """
import __spark_entry__ as e
from tidemark.queries import ORACLE, QUERIES
assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE), set(e.queries()) ^ set(QUERIES)
"""


@pytest.mark.parametrize("gone", [("tidemark/llm", "tests/llm"), ("tidemark/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_points_without_the_optional_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.suffix == "" else path.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    imports = [p for p in copy.rglob("*.py") if "tidemark.llm" in p.read_text() and p.name not in ("__spark_entry__.py", "corpus_pipeline.py", "test_removable.py")]
    assert not imports
