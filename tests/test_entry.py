"""The entry module with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    assert set(entry.entry(spark).columns) == {"lag", "f0", "f1", "len", "ncc"}
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_operators(tmp_path):
    for name in ("__spark_entry__.py", "lagweave"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys; sys.modules['lagweave.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'sx_01_repeat_map' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
