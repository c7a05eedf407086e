import __spark_entry__ as entry
from latticeqc.queries import all_queries


def test_entry_gives_one_row_per_package(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10
    assert {"package_id", "status", "face_count", "vertex_count"} <= set(rows[0].asDict())


def test_every_oracle_belongs_to_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(oracles) > 200
    assert set(all_queries.QUERIES) == set(all_queries.ORACLES)
