"""The driver contract, with and without the folder that may be taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["row", "col", "value"] and df.count() == 1166
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_alone(tmp_path):
    for name in ("__spark_entry__.py", "strataspark"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "strataspark" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n[2:3].isdigit() for n in q if n.startswith('op')); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_folder():
    for p in (ROOT / "strataspark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            text = p.read_text()
            assert "from .llm" not in text and "from ..llm" not in text and "strataspark.llm" not in text
