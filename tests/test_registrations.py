"""Queries over registrations take those of all users of the events."""

import datetime

import duckdb
import pytest

from ohmline.plans import fleet_queries, fleet_sql

USERS = (3, 4, 17, 30, None)


@pytest.mark.parametrize("name, users", [("p1_registration_history", 10), ("p17_registrations_text", 10), ("s8_latest_registrations", 5)])
def test_no_user_is_left_out(spark, tmp_path, name, users):
    day = datetime.datetime(2024, 1, 3)
    rows = [(i, u, day + datetime.timedelta(days=9 * w, hours=i)) for w in (0, 1) for i, u in enumerate(USERS)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    events.selectExpr("event_id", "user_id", "cast(ts as timestamp_ntz) as ts").write.parquet(f"{tmp_path}/events.parquet")
    found = fleet_queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    asked = con.execute(fleet_sql.SQL[name])
    names = [d[0] for d in asked.description]
    plain = lambda r: tuple(str(x) for x in r)
    assert found.count() == users
    assert sorted(plain(r) for r in found.select(*names).collect()) == sorted(plain(r) for r in asked.fetchall())
