"""The library works without its text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_entry_without_text_operators(tmp_path):
    for name in ("__spark_entry__.py", "helixloom"):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'prs_trait' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_them():
    others = [p for p in (REPO / "helixloom").rglob("*.py") if "llm" not in p.relative_to(REPO).parts]
    assert others and not any("llm" in line for p in others for line in p.read_text().splitlines() if line.lstrip().startswith(("import ", "from ")))
