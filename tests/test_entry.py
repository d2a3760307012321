"""The entry module with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'full_text' in q and set(s) <= set(q); print(*sorted(n for n in q if n.startswith('op') or n == 'pipeline'))"


@pytest.mark.parametrize("gone", [("llm",), ("corpus_pipeline.py",), ("llm", "corpus_pipeline.py")])
def test_entry_works_without_the_optional_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    done = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=300)
    assert done.returncode == 0, done.stderr
    found = done.stdout.split()
    assert found == [] if "llm" in gone or not os.path.exists(os.path.join(REPO, "quire", "llm")) else len(found) == 13 and "pipeline" not in found


def test_flagship(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["doc_id", "num_pages", "full_text"] and frame.count() == 200
