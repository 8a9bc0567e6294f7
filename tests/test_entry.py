"""The entry module with and without the parts that may be taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"


@pytest.mark.parametrize("gone", [["meshweave/llm", "tests/llm"], ["meshweave/llm", "tests/llm", "corpus_pipeline.py"]])
def test_loads_without_the_training_data_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        target = copy / name
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, check=False)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout) >= 69
