"""The entry stands on its own without the training-data operators."""

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT


@pytest.mark.parametrize("gone", [["paperloom/llm", "corpus_pipeline.py"], ["paperloom/llm"], ["corpus_pipeline.py"]])
def test_without_llm(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "tests", "__pycache__") or any(f"{folder}/{n}" == f"{ROOT}/{g}" for g in gone)])
    code = "import __spark_entry__ as e; q = set(e.queries()); o = set(e.oracle_sql()); assert o <= q and len(q) > 150; print(any(n.startswith('op1_') for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    llm = "paperloom/llm" not in gone
    there = llm and (copy / "paperloom/llm").exists()
    assert out.stdout.split() == [str(there), str(there and "corpus_pipeline.py" not in gone)], out.stderr
