"""Queries against their SQL on odd rows: times late in a second or before 1970, nulls, weights without mass."""

from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest

from keelson.plans import catalog

from .test_queries import plain

TIMES = ["NULL", "TIMESTAMP '2024-01-03 23:59:59.7'", "TIMESTAMP '2024-01-05 23:59:59.5'", "TIMESTAMP '2024-01-05 11:00:00'", "TIMESTAMP '1969-12-30 05:00:00'", "TIMESTAMP '1970-01-01 00:00:00.5'", "TIMESTAMP '2039-02-03 04:05:06'", "TIMESTAMP '2024-01-04 00:00:00.49'"]
NAMES = [
    "interval_cover",
    "event_frontier",
    "effective_counts",
    "decayed_load",
    "daily_ema",
    "cumulative_inventory",
    "bottom_k_per_day",
    "band_alignment",
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    path, con = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    times = "[" + ", ".join(TIMES) + "]"
    con.execute(f"""COPY (SELECT i AS event_id, ({times})[1 + i * 7 % 13 % 8] AS ts, CASE WHEN i % 29 > 0 THEN i % 9 END AS user_id, CASE WHEN i % 31 > 0 THEN 'type' || (i % 10 // 2) END AS event_type,
    CASE WHEN i % 9 = 1 THEN 0 WHEN i % 9 = 2 THEN -1.0 - i WHEN i % 9 = 3 THEN NULL WHEN i % 9 = 4 THEN i % 5 WHEN i % 9 = 5 THEN i - 90 WHEN i = 6 THEN 'nan'::DOUBLE WHEN i % 9 = 8 THEN (CASE WHEN i < 90 THEN -1 ELSE 1 END) ELSE 1.25 + i END::DOUBLE AS value, '' AS props
    FROM range(180) t(i)) TO '{path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT i AS o_orderkey, CASE WHEN i % 23 > 0 THEN i % 5 END AS o_custkey, 'O' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, CASE WHEN i % 5 < 4 THEN ({times})[1 + i * 7 % 13 % 8] + INTERVAL (i) DAY END AS o_orderdate, '1-URGENT' AS o_orderpriority
    FROM range(60) t(i)) TO '{path}/orders.parquet' (FORMAT parquet)""")
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return path, con


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_odd_rows_as_in_sql(spark, odd, name, zone):
    path, con = odd
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = catalog.QUERIES[name](spark, path)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL[name]}) AS q").fetchall()
        assert Counter(plain(map(tuple, got.collect()))) == Counter(plain(want))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def as_in_sql(spark, name, path, events):
    """Whether the query's rows on ``events`` (SQL) are those of its own SQL."""
    con = duckdb.connect()
    con.execute(f"COPY ({events}) TO '{path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    got = catalog.QUERIES[name](spark, str(path))
    rows = plain(map(tuple, got.collect()))
    return rows == plain(con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL[name]}) AS q").fetchall())


def test_bottom_k_per_day_of_events_without_id(spark, tmp_path):
    events = "SELECT CASE WHEN i % 3 > 0 THEN i END AS event_id, TIMESTAMP '2024-01-01 10:00:00' + INTERVAL (i // 6) DAY AS ts FROM range(600) t(i)"
    assert as_in_sql(spark, "bottom_k_per_day", tmp_path, events)


def test_bottom_k_per_day_of_infinite_times(spark, tmp_path):
    events = "SELECT i AS event_id, (['infinity', '-infinity', '294247-01-10 04:00:54', '290309-12-22 (BC) 00:00:00'])[1 + i % 4]::TIMESTAMP AS ts FROM range(40) t(i)"
    assert as_in_sql(spark, "bottom_k_per_day", tmp_path, events)


def test_decayed_load_of_halves(spark, tmp_path):
    """Events of eight days: many loads are halves in the sixth digit, to be rounded up as the decimals are."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01 10:00:00' + INTERVAL (hash(i) % 8) DAY AS ts, i % 300 AS user_id FROM range(20000) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = {r["user_id"]: r["load"] for r in catalog.QUERIES["decayed_load"](spark, str(tmp_path)).collect()}
    rows = con.execute(f"SELECT user_id, date_diff('day', ts, max(ts) OVER ()) FROM '{tmp_path}/events.parquet'").fetchall()
    want = dict.fromkeys(got, Decimal(0))
    for user, age in rows:
        want[user] += Decimal("0.9") ** age
    assert sum(x * 10**6 % 1 == Decimal("0.5") for x in want.values()) > 10
    assert got == {u: float(x.quantize(Decimal("0.000001"), ROUND_HALF_UP)) for u, x in want.items()}


def test_decayed_load_of_infinite_times(spark, tmp_path):
    events = "SELECT i % 7 AS user_id, CASE WHEN i % 7 = 3 OR i % 5 = 0 THEN (['infinity', '-infinity'])[1 + i % 2]::TIMESTAMP ELSE TIMESTAMP '2024-01-01 10:00:00' + INTERVAL (i) DAY END AS ts FROM range(60) t(i)"
    assert as_in_sql(spark, "decayed_load", tmp_path, events)


def test_group_disjoint_split_of_nulls_without_broadcasts(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS doc_id, CASE WHEN i % 7 > 0 THEN 'text ' || (i * 5 % 37) END AS text, 'en' AS lang, CASE WHEN i % 11 > 0 THEN 's' || i % 3 END AS source, CASE WHEN i % 13 > 0 THEN i::BIGINT % 60 END AS n_chars
    FROM range(90) t(i)) TO '{tmp_path}/documents.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        got = catalog.QUERIES["group_disjoint_split"](spark, str(tmp_path))
        rows = plain(map(tuple, got.collect()))
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert rows == plain(con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL['group_disjoint_split']}) AS q").fetchall())


def test_group_disjoint_split_of_long_chains(spark, tmp_path):
    """Each document shares its text with one neighbour, its length with the other; least ids travel a chain the long way."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT CASE WHEN i = 0 THEN 0 ELSE 90 - i END + 90 * c AS doc_id, 'text ' || c || '/' || i // 2 AS text, 'en' AS lang, 's' || c AS source, (i + 1) // 2 AS n_chars
    FROM range(90) t(i), range(2) u(c) UNION ALL SELECT NULL, 'text 0/3', 'en', 's9', 1) TO '{tmp_path}/documents.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = catalog.QUERIES["group_disjoint_split"](spark, str(tmp_path))
    rows = plain(map(tuple, got.collect()))
    assert rows == plain(con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL['group_disjoint_split']}) AS q").fetchall())
