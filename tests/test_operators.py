"""Rules that the queries over the test tables don't reach."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import canonical, control, ingest, serving


def value(spark, column, schema, *row):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "prev,prev_value,new,new_value,n,drift,fork",
    [(0, "a", 0, "b", 0, False, 0), (5, "a", 4, "b", 3, True, 4), (5, "a", 5, "A ", 0, True, 5), (5, "a", 5, " a", 0, False, 5), (5, "a", 5, "b", 1, False, 5), (5, None, 4, "b", 0, False, 4), (9, "a", 7, "b", 2, True, 6)],
)
def test_drift_and_fork(spark, prev, prev_value, new, new_value, n, drift, fork):
    schema = "p long, pv string, n long, nv string, t int, f long"
    c = [F.col(x) for x in ("p", "pv", "n", "nv")]
    row = (prev, prev_value, new, new_value, n, 6 if prev == 9 else None)
    assert value(spark, ingest.drifted(*c, F.lit("solana"), F.col("t")), schema, *row) is drift
    assert value(spark, ingest.fork_cursor(F.col("p"), F.col("n"), F.col("f")), schema, *row) == fork


def test_btc_fee_gate(spark):
    events = spark.createDataFrame([("t1", "vin_spend", "p", "-100", "WITHDRAWAL"), ("t1", "vout_receive", "q", "90", "DEPOSIT"), ("t1", "vout_receive", "p", "10", "DEPOSIT"), ("t2", "vin_spend", "p", "-100", "WITHDRAWAL"), ("t2", "vout_receive", "q", "80", "DEPOSIT"), ("t2", "vout_receive", "p", "11", "DEPOSIT")], "tx_hash string, action string, address string, delta string, activity string")
    txs = spark.createDataFrame([("t1", "p", "10"), ("t2", "p", "9"), ("t3", "p", "5")], "tx_hash string, fee_payer string, fee_amount string")
    assert {r.tx_hash for r in canonical.gated_btc_fees(events, txs).collect()} == {"t2", "t3"}


def test_alias_collapse(spark):
    rows = [("t", "TRANSFER", "a", "x", "c", "1", True, {"k": "own"}), ("t", "TRANSFER", "a", "x", "c", "1", False, {"k": "other", "m": "2"}), ("t", "TRANSFER", "a", "x", "c", "1", False, {"m": "1"}), ("u", "TRANSFER", "a", "x", "c", "1", False, {}), ("u", "TRANSFER", "a", "x", "c", "1", False, {})]
    got = canonical.alias_collapsed(spark.createDataFrame(rows, "tx_hash string, category string, address string, asset string, counterparty string, delta string, path_hinted boolean, metadata map<string,string>")).collect()
    assert [r.metadata for r in got if r.tx_hash == "t"] == [{"k": "own", "m": "1"}] and sum(r.tx_hash == "u" for r in got) == 2


def test_ranges(spark):
    marks = spark.createDataFrame([("a", "m", 9, 20), ("b", "m", None, 20), ("c", "m", 20, 20), ("d", "m", 0, 20)], "chain string, network string, ingested_sequence long, head long")
    assert {(r.chain, r.start_block, r.end_block) for r in control.planned_ranges(marks, 5).collect()} == {("a", 10, 14), ("b", 0, 4), ("d", 0, 4)}
    assert {(r.chain, r.start_block, r.end_block) for r in control.planned_ranges(marks, 5, 3).collect()} == {("a", 10, 14), ("b", 18, 20), ("d", 18, 20)}


def test_breaker_and_alerts(spark):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    calls = [("c", at(s), i, e) for i, (s, e) in enumerate([(0, True), (1, True), (2, False), (40, False), (41, False), (42, True), (43, False)])]
    got = control.breaker(spark.createDataFrame(calls, "chain string, ts timestamp, ordinal long, is_error boolean"), failures=2, successes=2, open_s=30).orderBy("ordinal").collect()
    assert [(r.allowed, r.state) for r in got] == [(True, "closed"), (True, "open"), (False, "open"), (True, "half_open"), (True, "closed"), (True, "closed"), (True, "closed")]
    alerts = [("c", "m", k, at(s), i) for i, (k, s) in enumerate([("down", 0), ("down", 10), ("up", 20), ("down", 30), ("down", 400)])]
    got = control.sent_alerts(spark.createDataFrame(alerts, "chain string, network string, alert_type string, ts timestamp, ordinal long")).orderBy("ordinal").collect()
    assert [r.sent for r in got] == [True, False, True, True, True]


def test_serving_upserts(spark):
    book = spark.createDataFrame([("c", "m", "o1", "a", "n1", "ACTIVE"), ("c", "m", "o2", "a", "n2", "INACTIVE")], "chain string, network string, org_id string, address string, name string, status string")
    new = spark.createDataFrame([("c", "m", "o2", "a", "n3", "ACTIVE"), ("c", "m", "o3", "b", "n4", "ACTIVE")], book.schema)
    after = serving.book_upsert(book, new)
    assert {(r.org_id, r.name) for r in after.collect()} == {("o1", "n1"), ("o2", "n3"), ("o3", "n4")}
    assert serving.found_in_book(after, "c", "m", "o2", "a").first().name == "n3"
    assert [r.org_id for r in serving.book_delete(after, "c", "m", "a").collect()] == ["o3"]
    assert ingest.inserted_if_absent(book, new, ["org_id"], [F.col("name")]).count() == 3


def test_targets_and_wiring(spark):
    targets = spark.createDataFrame([("Base", "g"), ("btc", "h")], "name string, runtime_group string")
    assert {(r.name, r.missing) for r in control.selected_targets(targets, "g", [" BASE", "btc", "base"]).collect()} == {("base", False), ("btc", True)}
    rows = spark.createDataFrame([("a", "m", "a", "g", "g"), ("a", "m", "a", "g", "g"), ("b", "m", "c", "g", "g"), ("d", "m", "d", "g", "g")], "chain string, network string, adapter_chain string, runtime_group string, group string")
    assert sorted(r.fault for r in control.wiring_faults(rows).collect()) == ["adapter_mismatch", "duplicate", "duplicate"]
