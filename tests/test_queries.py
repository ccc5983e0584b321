import os
import shutil
import subprocess
import sys

import pytest
from oracle import same

from sparkquill.plans.catalog import ORACLES, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(df, ORACLES[name], sf)
    else:
        assert df.count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_training_data_package(tmp_path):
    ignore = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache")
    for gone in ((), ("corpus_pipeline.py",)):
        copy = shutil.copytree(ROOT, tmp_path / f"copy{len(gone)}", ignore=ignore)
        for name in gone:
            (copy / name).unlink()
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'hybrid_search' in q; print(sum(n.startswith('op') or n == 'pipeline' for n in q))"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0 and done.stdout.strip() == "0", done.stderr
