"""Every query against its SQL, on the smallest data."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from checks import CHECKS
from checks.compare import connect, differences

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", CHECKS)
def test_query(spark, con, name):
    found = differences(spark, con, name, SMALL)
    # the smallest data may lack the rare rows a query reports
    assert [f for f in found if f != "no rows"] == []


def test_entry(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0


WITHOUT = """
import sys
sys.modules["jobtide.llm"] = None
import __spark_entry__ as entry
from checks import CHECKS
assert set(entry.queries()) == set(CHECKS), set(entry.queries()) ^ set(CHECKS)
assert set(entry.oracle_sql()) <= set(CHECKS)
"""


def test_entry_without_the_training_data_part():
    root = Path(entry_points.__file__).resolve().parent
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
