"""The driver's contract."""

import __spark_entry__ as entry
from lodestone.plans.queries import ORACLES, QUERIES


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(QUERIES) <= set(queries)
    assert set(QUERIES) == set(ORACLES) and {"job1_index_documents", "job2_publish_passages"} <= set(sql)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
