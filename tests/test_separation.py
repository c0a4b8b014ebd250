"""The library and its entry work without the optional corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
IMPORT = "import __spark_entry__ as e; assert not any(n.startswith('op') and n[2].isdigit() for n in e.queries()); assert 'pipeline' not in e.queries(); assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_import_without_corpus_operators(tmp_path, pipeline):
    copy = tmp_path / "repo"
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, copy, ignore=skip)
    done = subprocess.run([sys.executable, "-c", IMPORT], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 100
