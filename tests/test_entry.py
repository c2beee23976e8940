"""The entry module without its optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
{before}
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q, set(s) <= set(q))
"""


def ask(folder, before=""):
    env = os.environ | {"PYTHONPATH": str(folder)}
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", CODE.format(before=before)], cwd=folder, env=env, capture_output=True, text=True, check=True)
    n, ops, pipeline, named = out.stdout.split()
    return int(n), int(ops), pipeline == "True", named == "True"


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_without_the_optional_folder(copy):
    n, ops, pipeline, named = ask(copy)
    assert n > 50 and ops == 0 and not pipeline and named


def test_with_something_missing_that_the_optional_part_needs():
    n, ops, pipeline, named = ask(ROOT, "sys.modules['public_tokenizers'] = None")
    assert n > 50 and ops == 0 and not pipeline and named
