"""The library loads without the operators for training data, with and without the pipeline's file."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_load_without_the_operators(tmp_path, pipeline):
    shutil.copytree(os.path.join(ROOT, "docketlake"), tmp_path / "docketlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    names = ["__spark_entry__.py"] + (["corpus_pipeline.py"] if pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")) else [])
    for name in names:
        shutil.copy(os.path.join(ROOT, name), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 180 and 'pipeline' not in q and set(o) < set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
