"""The library without the training-data subpackage: entry, queries and SQL are there."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = """
import re, __spark_entry__ as e
names, sql = set(e.queries()), set(e.oracle_sql())
assert len(names) > 190 and sql <= names and not any(re.match(r"op\\d+_|pipeline", n) for n in names), names
import sys
assert not any(m.startswith("worklens.llm") for m in sys.modules)
print("fine")
"""


def test_import_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "worklens", tmp_path / "worklens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    got = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert got.stdout.strip().endswith("fine"), got.stderr[-2000:]


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "worklens").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "worklens.llm" not in path.read_text(), path
