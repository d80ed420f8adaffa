"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from tests.oracle import connect, oracle_rows, rows_of
from tidemark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert rows_of(QUERIES[name](spark, SF)) == oracle_rows(con, ORACLES[name])


def test_queries_without_sql_are_these():
    assert set(QUERIES) - set(ORACLES) == {"a13_content_digest", "i05_frame_digests", "d28_ridge"}  # see test_whole_queries


def test_entry_has_stable_columns(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["feature_id", "idx", "n", "ic"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
