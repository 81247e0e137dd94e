import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["rank", "doc_id", "score"]


def test_entry_imports_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "tamarack"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "tamarack").mkdir()
    for p in (ROOT / "tamarack").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "tamarack" / p.name).symlink_to(p)
    (tmp_path / "corpus_pipeline.py").symlink_to(ROOT / "corpus_pipeline.py")  # there, but without what it imports
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert out.stdout.split()[1] == "False"
