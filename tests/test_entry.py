import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from seqframe.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NO_SQL: set[str] = set()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_sql():
    assert set(QUERIES) - set(entry.oracle_sql()) == NO_SQL


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def test_entry_without_the_other_package():
    """The queries of this library stand without the package that the entry adds if it is there."""
    code = ("import sys; sys.modules['corpus_pipeline'] = None; import builtins; real = builtins.__import__\n"
            "def gone(name, *a, **k):\n"
            "    if name.startswith('corpus_pipeline'): raise ModuleNotFoundError(name, name='corpus_pipeline')\n"
            "    return real(name, *a, **k)\n"
            "builtins.__import__ = gone\n"
            "import __spark_entry__ as e; from seqframe.plans.queries import QUERIES\n"
            "assert set(e.queries()) == set(QUERIES)")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
