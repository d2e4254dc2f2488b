"""Every registered query: equal to its SQL, or at least rows with a stable schema."""

import os

import pytest
from compare_engines import connect, difference, run_spark, run_sql

import __spark_entry__ as entry
from siftmill.queries.base import COVERS

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Operators of the inventory, by prefix and last number; P12 does not exist.
INVENTORY = {"IO": 9, "P": 14, "T": 13, "HF": 4, "FA": 15, "J": 7, "A": 5, "L": 7, "S": 3, "Q": 17, "SC": 7, "IV": 6, "C": 1, "M": 16, "ML": 16, "E": 11, "R": 15, "X": 10, "ST": 1, "U": 3}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert difference(run_spark(QUERIES[name](spark, SF)), run_sql(duck, ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    columns, rows = run_spark(QUERIES[name](spark, SF))
    assert rows and columns


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 7 and df.columns == ["feature", "auc"]


def test_inventory_is_covered():
    covered = {i for ids in COVERS.values() for i in ids.split(",")}
    wanted = {f"{p}{i}" for p, n in INVENTORY.items() for i in range(1, n + 1)} - {"P12"}
    assert wanted <= covered
