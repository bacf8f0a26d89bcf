"""Every registered query against its SQL twin on the smallest tables."""

import os
import re
import sys

import pytest
from conftest import ROOT, SF

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_oracles  # noqa: E402

# The numbered operators and the pipeline have tests of their own.
NAMES = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)]


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert check_oracles.compare(spark, con, SF, name) == ""


def test_every_query_has_a_twin():
    assert set(NAMES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 500
