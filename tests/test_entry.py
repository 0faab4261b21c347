"""The entry without the operators of a training-data pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_the_rest_imports_without_that_subpackage(tmp_path, with_pipeline):
    gone = {"llm", ".git", "__pycache__", ".pytest_cache", "spark-warehouse"} | (set() if with_pipeline else {"corpus_pipeline.py"})
    shutil.copytree(HERE, tmp_path / "repo", ignore=lambda _, names: [n for n in names if n in gone])
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); "
         "assert len(q) > 200 and not any(n.startswith('op') and n[2:3].isdigit() for n in q) and 'pipeline' not in q and set(s) <= set(q)"],
        cwd=tmp_path / "repo", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert said.returncode == 0, said.stderr
