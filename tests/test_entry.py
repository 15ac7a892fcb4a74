"""The entry goes on without the part that can be taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from harborline.plans import QUERIES

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("gone", [("harborline/llm",), ("corpus_pipeline.py",), ("harborline/llm", "corpus_pipeline.py")])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    keep = shutil.ignore_patterns(".git", "__pycache__", "tests", *[Path(g).name for g in gone])
    shutil.copytree(ROOT, tmp_path / "copy", ignore=keep)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    count, oracles, has_ops = found.stdout.split()
    assert int(count) == len(QUERIES) and int(oracles) <= int(count) and has_ops == "False"
