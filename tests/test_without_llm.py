"""The engine stands without the training-data operators."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_them():
    for path in (ROOT / "actloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "actloom").parts:
            assert not re.search(r"\bimport .*\bllm\b|\bllm\b.* import ", path.read_text()), path


def test_entry_names_and_oracles():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_entry_works_without_the_optional_folders(tmp_path):
    """A copy without them imports, and lists the engine's queries and their SQL."""
    import shutil
    import subprocess
    import sys

    shutil.copytree(ROOT / "actloom", tmp_path / "actloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(n.startswith('op') and n[2:3].isdigit() for n in q) or 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    n, equal, optional = out.stdout.split()
    assert int(n) > 100 and equal == "True" and optional == "False"
