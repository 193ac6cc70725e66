import duckdb
import pytest

import __spark_entry__ as entry
from oracle import connect, rows
from tessella.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_says_what_its_sql_says(spark, data, name):
    got = QUERIES[name](spark, data).toPandas()
    want = connect(data).execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, data, name):
    QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_clocks_of_odd_times(spark, tmp_path):
    """Half a millisecond before an hour is that hour in the SQL; an hour that the session's zone lacks is one; no number comes last."""
    odd = "(1, '2024-03-10 02:30:00', 1), (2, '2024-03-10 02:59:59.9995', 1), (3, '2024-03-10 01:59:59', 1), (4, NULL, 1), (NULL, '2025-01-01', 1), (1, '1969-12-31 23:30:00', 2), (2, '1969-12-31 22:00:00.0004', 2), (3, '1970-01-01 00:59:59.999499', 2), (4, '1970-01-01 00:59:59.9995', 2)"
    duckdb.execute(f"COPY (SELECT id::BIGINT AS event_id, ts::TIMESTAMP AS ts, u::BIGINT AS user_id FROM (VALUES {odd}) v(id, ts, u)) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.execute(ORACLE_SQL["clock_advance"]).fetchall(), key=repr)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert sorted(map(tuple, QUERIES["clock_advance"](spark, str(tmp_path)).collect()), key=repr) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
