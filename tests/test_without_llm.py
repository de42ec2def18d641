"""The repository without its optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"


def test_entry_imports_without_the_subpackage_and_with_or_without_the_pipeline_file(tmp_path):
    for keep in (True, False):
        to = f"{tmp_path}/{keep}"
        shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if keep else ["corpus_pipeline.py"])))
        run = subprocess.run([sys.executable, "-c", COUNT], cwd=to, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": to})
        assert run.returncode == 0 and int(run.stdout) > 150, run.stderr
