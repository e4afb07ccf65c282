"""Nothing outside the corpus subpackage imports it, and the entry points do without it."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "agentlake", tmp_path / "agentlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, agentlake.facade; print(len(e.queries()) > 80, any(q.startswith('op') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})
    assert out.stdout.split() == ["True", "False"], out.stderr


def test_no_module_names_it():
    for path in (ROOT / "agentlake").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
