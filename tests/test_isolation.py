"""The library without the corpus operators: a copy that lacks their folders still registers and answers."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROBE = """
import __spark_entry__ as e
names = set(e.queries())
assert "r01_reorder_plan" in names and set(e.oracle_sql()) < names
assert not [n for n in names if n.startswith("op") or n == "pipeline"], names
print(len(names))
"""


@pytest.mark.parametrize("gone", [("shelfcast/llm", "tests/llm"), ("shelfcast/llm", "tests/llm", "corpus_pipeline.py")])
def test_a_copy_without_the_corpus_folder_registers_the_other_queries(tmp_path, gone):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "__pycache__", *[os.path.basename(g) for g in gone if g.endswith(".py")])

    def ignore(folder, names):
        left_out = set(skip(folder, names))
        inside = os.path.relpath(folder, ROOT)
        return left_out | {n for n in names if os.path.normpath(os.path.join(inside, n)) in gone}

    shutil.copytree(ROOT, copy, ignore=ignore)
    env = {**os.environ, "PYTHONPATH": str(copy)}
    ran = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    assert int(ran.stdout) > 100
