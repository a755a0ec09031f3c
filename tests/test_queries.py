"""Every registered query of the engine's own operators against its SQL; the others are run and must give rows."""

import pytest
from conftest import TESTDATA

from callgrid.plans import report_queries  # noqa: F401
from callgrid.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, same, name):
    df = QUERIES[name](spark, TESTDATA)
    if name in ORACLES:
        same(df, ORACLES[name])
    else:
        assert df.count() > 0


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_entry_without_llm(tmp_path):
    """With both llm folders deleted, with and without the pipeline's file, the entry and all other tests can be imported."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for folder in ("callgrid/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert names and set(e.oracle_sql()) <= names; " \
        "assert not any(n.startswith('op') or n == 'pipeline' for n in names)"
    env = {"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1", "PYTHONPATH": str(copy)}
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True)
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    collected = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=copy, env=env,
        capture_output=True, text=True)
    assert collected.returncode == 0, collected.stdout[-2000:]
