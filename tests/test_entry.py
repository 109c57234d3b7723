"""The entry's only guard: the llm folders may be absent, but not broken."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'op4_bpe' in e.queries(), 'pipeline' in e.queries())"


def run(folder):
    others = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and Path(p).resolve() != ROOT]
    env = os.environ | {"PYTHONPATH": ":".join([str(folder), *others])}
    return subprocess.run([sys.executable, "-c", COUNT], cwd=folder, env=env, capture_output=True, text=True, timeout=120)


def test_without_and_with_broken_llm(tmp_path):
    shutil.copytree(ROOT / "corpusq", tmp_path / "corpusq", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    alone = run(tmp_path)
    assert alone.returncode == 0, alone.stderr
    assert alone.stdout.split()[2:] == ["False", "False"] and int(alone.stdout.split()[0]) > 100
    (tmp_path / "corpusq/llm").mkdir()
    (tmp_path / "corpusq/llm/__init__.py").write_text("")
    (tmp_path / "corpusq/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    broken = run(tmp_path)
    assert broken.returncode != 0 and "a_module_that_is_not_there" in broken.stderr
