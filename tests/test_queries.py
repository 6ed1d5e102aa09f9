"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import pytest

from quillspark.plans import queries as Q

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, name):
    compare(Q.QUERIES[name](spark, SF), Q.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_training_data_package():
    """The other queries work where the subpackage and the pipeline are missing."""
    import subprocess
    import sys

    code = "import sys; sys.modules['quillspark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(x.startswith('op') for x in q)"
    import os

    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
