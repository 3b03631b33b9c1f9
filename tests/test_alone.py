"""The engine stands alone: without the corpus operators' folders everything else still imports and registers."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_without_the_corpus_operators(tmp_path, with_pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    if not with_pipeline and (copy / "corpus_pipeline.py").exists():
        (copy / "corpus_pipeline.py").unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    assert got.stdout.split()[1:] == ["False", "False"]
