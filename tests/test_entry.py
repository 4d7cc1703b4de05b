import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and rows[0].bm25_score >= rows[-1].bm25_score


def test_imports_without_the_training_data_operators(tmp_path):
    """The entry and the engine's queries load where the llm folders and the pipeline are missing."""
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    (tmp_path / "tessera").mkdir()
    for p in (ROOT / "tessera").iterdir():
        if p.name != "llm":
            (tmp_path / "tessera" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    copy = tmp_path / "run.py"
    copy.write_text(code)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    done = subprocess.run([sys.executable, str(copy)], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
