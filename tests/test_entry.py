"""The entry points without the text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_text_operators(tmp_path):
    """A copy without them has all other queries, whether or not the pipeline's file is left."""
    keep = shutil.ignore_patterns(".git", "llm", "__pycache__", "tests")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=keep)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q) and not [k for k in q if k.startswith('op') or k == 'pipeline'], q; print(len(q))"
    counts = []
    for _ in range(2):
        run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}, timeout=120, check=True)
        counts.append(int(run.stdout.split()[-1]))
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
    assert counts[0] == counts[1] > 140
