import subprocess
import sys

import pytest

import lumenframe.queries_more  # noqa: F401
import lumenframe.queries_regions  # noqa: F401
from lumenframe.queries import ORACLES, QUERIES
from tests.conftest import ROOT
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    check(spark, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_subpackage(tmp_path):
    """The entry module imports, and lists the other queries, where the subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "lumenframe", tmp_path / "lumenframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'nms_greedy' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
