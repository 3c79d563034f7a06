"""The driver contract holds with and without the subpackage for training text."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def names(folder):
    done = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return eval(done.stdout)


def test_entry_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "tests"))
    with_pipeline = names(copy)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert with_pipeline == names(copy) and "voxel_statistics" in with_pipeline and "pipeline" not in with_pipeline
