"""The rest of the repository without the subpackage of text and vector operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = """
import __spark_entry__ as e
from grainfield.plans import queries, table_queries, wide_queries
own = (queries, table_queries, wide_queries)
assert set(e.queries()) == {k for m in own for k in m.QUERIES} and set(e.oracle_sql()) == {k for m in own for k in m.ORACLE}, set(e.queries())
"""


def _copy(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    return tmp_path / "copy"


def test_queries_without_llm(tmp_path):
    """With the folders gone, whether or not the pipeline's file is still there, the factor queries are all there is."""
    copy = _copy(tmp_path)
    for left in (False, True):
        if not left and (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").rename(tmp_path / "aside.py")
        elif left and (tmp_path / "aside.py").exists():
            (tmp_path / "aside.py").rename(copy / "corpus_pipeline.py")
        got = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert got.returncode == 0, got.stderr


def test_nothing_else_imports_llm(tmp_path):
    for folder, _, names in os.walk(_copy(tmp_path) / "grainfield"):
        for n in names:
            assert "llm" not in open(os.path.join(folder, n), encoding="utf-8").read(), n
