"""The entry point works without the optional corpus operators, their pipeline, or both."""

import os
import shutil
import subprocess
import sys

import pytest

from basket_engine.catalog import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("corpus", [True, False])
@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_optional_parts(tmp_path, corpus, pipeline):
    there = os.path.isdir(os.path.join(ROOT, "basket_engine", "llm")), os.path.exists(os.path.join(ROOT, "corpus_pipeline.py"))
    if corpus and not there[0] or pipeline and not there[1]:
        pytest.skip("not there at all")
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    skipped = ["__pycache__"] if corpus else ["llm", "__pycache__"]
    shutil.copytree(os.path.join(ROOT, "basket_engine"), tmp_path / "basket_engine", ignore=shutil.ignore_patterns(*skipped))
    if pipeline:
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(sum(n[:2] != 'op' and n != 'pipeline' for n in q), any(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.stdout.split() == [str(len(QUERIES)), str(corpus), str(corpus and pipeline), "True"], done.stderr
