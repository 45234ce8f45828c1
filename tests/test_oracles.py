"""Every query with SQL gives the same rows as that SQL, on the smallest tables."""

import pytest

from workload.catalog import ORACLES, QUERIES
from workload.compare import oracle_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == oracle_rows(SF, ORACLES[name])


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry_points

    frame = entry_points.entry(spark)
    assert frame.columns == ["brand_name", "mention_count", "total_prompts", "mention_share_pct"]
    assert frame.count() > 0
