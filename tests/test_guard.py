"""The entry point works where the llm folders and the pipeline are deleted."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "attestor"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    run = "import __spark_entry__ as e; names = list(e.queries()); assert names and set(e.oracle_sql()) <= set(names); assert not [n for n in names if n.startswith('op') and n[2].isdigit()], names"
    done = subprocess.run([sys.executable, "-B", "-c", run], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_entry_with_emptied_folder(tmp_path):
    """What a deletion may leave: the pipeline's file, and a folder with nothing but caches in it."""
    shutil.copytree(ROOT / "attestor", tmp_path / "attestor", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "attestor" / "llm" / "__pycache__").mkdir(parents=True)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    run = "import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries() and 'pipeline' not in e.oracle_sql()"
    done = subprocess.run([sys.executable, "-B", "-c", run], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_nothing_else_imports_llm():
    for path in ROOT.glob("attestor/**/*.py"):
        if "llm" not in path.parts:
            assert "attestor.llm" not in path.read_text(), path
