"""Rows that only larger tables have, in small tables made for them: each query against its SQL in DuckDB."""

import duckdb
import pytest

from ledgerloom.plans import ledger_queries, source_queries  # noqa: F401
from ledgerloom.plans.queries import ORACLE_SQL, QUERIES
from ledgerloom.plans.views import TABLES
from ledgerloom.sources import evm


@pytest.fixture(scope="module")
def made(tmp_path_factory, data):
    """Order 0 of a watched payer; orders 2 and 4 of payer 7, none of whose parties are watched; an order whose quantity ends just below 2^32; a watched customer without orders."""
    folder, con = tmp_path_factory.mktemp("made"), duckdb.connect()
    rows = {
        "customer": "SELECT * REPLACE (CASE WHEN c_custkey IN (3, 149) THEN 'BUILDING' WHEN c_custkey IN (2, 4, 7) THEN 'FURNITURE' ELSE c_mktsegment END AS c_mktsegment) FROM {}",
        "orders": "SELECT * REPLACE (CASE o_orderkey WHEN 39 THEN 2416488 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey = 0 THEN 3 WHEN o_orderkey IN (2, 4) THEN 7 ELSE o_custkey % 140 END AS o_custkey, 'O' AS o_orderstatus) FROM {} WHERE o_orderkey < 40",
    }
    for t in TABLES:
        con.execute(f"COPY ({rows.get(t, 'SELECT * FROM {}').format(repr(f'{data}/{t}.parquet'))}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


def both(name, spark, made):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{made}/{t}.parquet'")
    df = QUERIES[name](spark, made)
    text = lambda rows, names: sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in rows)
    want = con.sql(ORACLE_SQL[name])
    return text([tuple(r) for r in df.collect()], df.columns), text(want.fetchall(), want.columns)


def test_an_address_without_balances(spark, made):
    got, want = both("balance_entries", spark, made)
    assert got == want and any("::" in r for r in got)


def test_a_log_of_nothing(spark, made):
    got, want = both("evm_log_events", spark, made)
    assert got == want and any("0xTX0" in r for r in got)


def test_only_readable_zeros_are_events(spark):
    from test_sources import A, B, C, evm_payload, frame, topic, watched

    logs = [{"address": C, "topics": [evm.TRANSFER_TOPIC, topic(A), topic(B)], "data": d, "logIndex": hex(i)} for i, d in enumerate(["0x0", "0x000", "0x", "zz", "0x5"])]
    decoded = evm.transactions(frame(spark, evm_payload(value="0x0", logs=logs)))
    paths = lambda **more: sorted(e.event_path for e in evm.balance_events(decoded, watched(spark, B), **more).collect())
    assert paths() == ["log:4"] and paths(zeros=True) == ["log:0", "log:1", "log:4"]


def test_a_quantity_just_below_a_power(spark, made):
    got, want = both("hex_quantities", spark, made)
    assert got == want and any("2416488" in r for r in got)


def test_a_token_transfer_of_nothing(spark, made):
    got, want = both("solana_token_events", spark, made)
    assert got == want and any("0xTX0" in r for r in got)


def test_a_scan_for_an_account_of_logs_only(spark, made):
    got, want = both("log_scan", spark, made)
    assert got == want and not any("0xTX2" in r or "0xTX4" in r for r in got)


def test_a_scan_where_the_address_of_zeros_is_watched(spark, made, tmp_path):
    for t in TABLES:
        where = " REPLACE (CASE c_custkey WHEN 0 THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment)" if t == "customer" else ""
        duckdb.sql(f"COPY (SELECT *{where} FROM '{made}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got, want = both("log_scan", spark, str(tmp_path))
    assert got == want and any("0xTX0" in r for r in got) and not any("0xTX2" in r or "0xTX4" in r for r in got)
