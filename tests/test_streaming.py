"""Micro-batches through the store: idempotent, and equal to one batch; promotion and rollback."""

import random

from pyspark.sql import functions as F

from ledgerloom.streaming import ingest as stream
from ledgerloom.streaming.store import LedgerStore


def events(n, seed):
    rng = random.Random(seed)
    return [(f"e{rng.randrange(n)}", rng.choice(["base", "btc"]), "mainnet", f"a{rng.randrange(4)}", "c", "t", "NATIVE", "x", rng.choice(["DEPOSIT", "STAKE"]), f"h{i}", i % 50, str(rng.randint(-9, 9)), rng.choice(["pending", "confirmed", "finalized"]), i) for i in range(n)]


def amounts(df):
    return {(r.chain, r.address, r.balance_type): int(r.amount) for r in df.collect() if r.amount}


def test_stream_equals_batch(spark, tmp_path):
    seen = {}
    rows = [seen.setdefault(r[0], r)[:12] + r[12:] for r in events(80, 1)]  # one amount per id, as ids are made of content
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[k::3], stream.INPUT).coalesce(1).write.mode("append").parquet(str(source))
    store = LedgerStore(spark, f"file://{tmp_path}/store", stream.TABLES)
    df = spark.readStream.schema(stream.INPUT).option("maxFilesPerTrigger", 1).parquet(str(source))
    for _ in range(2):  # a second start finds nothing new
        stream.started(df, store, str(tmp_path / "check")).awaitTermination()
    assert store.current()["batch"] == 2
    got = {r.event_id: r.delta for r in store.read("events").collect()}
    assert got == {r[0]: r[11] for r in rows}
    ledger = store.read("events").where("balance_applied").groupBy("chain", "address").agg(F.sum(F.col("delta").cast("long")).alias("n"))
    liquid = {k[:2]: v for k, v in amounts(store.read("balances")).items() if k[2] == ""}
    assert liquid == {(r.chain, r.address): r.n for r in ledger.collect() if r.n}
    assert stream.ingest_batch(store, spark.createDataFrame(rows, stream.INPUT), 1) is False


def test_promotion_and_rollback(spark):
    empty = {n: spark.createDataFrame([], s) for n, s in stream.SCHEMAS.items()}
    rows = [("e1", "base", "mainnet", "a", "c", "t", "NATIVE", "x", "DEPOSIT", "h", 5, "10", "pending", 1), ("e2", "base", "mainnet", "a", "c", "t", "NATIVE", "x", "DEPOSIT", "h", 9, "7", "confirmed", 2)]
    state = stream.next_state(empty, spark.createDataFrame(rows, stream.INPUT))
    assert amounts(state["balances"]) == {("base", "a", ""): 7}
    up = stream.promoted_state(state, "base", "mainnet", 6)
    assert amounts(up["balances"]) == {("base", "a", ""): 17}
    back = stream.rolled_back_state(state | up, "base", "mainnet", 6)
    assert amounts(back["balances"]) == {("base", "a", ""): 10}
    assert back["watermarks"].first().ingested_sequence == 5


def test_error_rates_and_floor(spark, tmp_path):
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("base", t0 + datetime.timedelta(minutes=i), i % 2 == 0) for i in range(30)], "chain string, ts timestamp, is_error boolean").coalesce(1).write.parquet(str(tmp_path / "s"))
    src = spark.readStream.schema("chain string, ts timestamp, is_error boolean").parquet(str(tmp_path / "s"))
    q = stream.error_rates(src).writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(calls) c, sum(errors) e, count(*) n from rates").first() == (30, 15, 6)
    schema = "signature string, path string, address string, asset string, category string"
    for rows in ([("s", "p", "a", "x", "t"), ("s", "q", "a", "x", "t")], [("s", "p", "a", "x", "T")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    q = stream.coverage_floor(src, ttl_ms=None).writeStream.format("memory").queryName("floor").outputMode("update").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(r.n_events for r in spark.table("floor").collect()) == 2


def test_a_crash_before_the_pointer_leaves_the_version_before(spark, tmp_path, monkeypatch):
    import pytest

    store = LedgerStore(spark, f"file://{tmp_path}/store", stream.TABLES)
    rows = [("e1", "base", "mainnet", "a", "c", "t", "NATIVE", "x", "DEPOSIT", "h", 5, "10", "confirmed", 1)]
    assert stream.ingest_batch(store, spark.createDataFrame(rows, stream.INPUT), 0)
    more = [("e2", *rows[0][1:])]
    with monkeypatch.context() as m:
        m.setattr(LedgerStore, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            stream.ingest_batch(store, spark.createDataFrame(more, stream.INPUT), 1)
    assert store.current()["batch"] == 0 and [r.event_id for r in store.read("events").collect()] == ["e1"]
    (tmp_path / "store" / "pointers" / ".000000000001-part").write_text("{")  # a pointer that was never moved
    assert stream.ingest_batch(store, spark.createDataFrame(more, stream.INPUT), 1)
    assert amounts(store.read("balances")) == {("base", "a", ""): 20} and store.versions() == [0, 1]


def test_a_batch_writes_what_it_changes(spark, tmp_path, monkeypatch):
    from ledgerloom.streaming import store as module

    monkeypatch.setattr(module, "COMPACT", 3)
    store = LedgerStore(spark, f"file://{tmp_path}/store", stream.TABLES)
    row = lambda i, state: (f"e{i}", "base", "mainnet", f"a{i % 3}", "c", "t", "NATIVE", "x", "DEPOSIT", f"h{i}", i, "10", state, i)
    stream.ingest_batch(store, spark.createDataFrame([row(i, "pending") for i in range(100)], stream.INPUT), 0)
    assert amounts(store.read("balances")) == {}
    for k in range(1, 6):
        stream.ingest_batch(store, spark.createDataFrame([row(k, "confirmed"), row(k, "finalized")], stream.INPUT), k)
        segments = store.current()["tables"]["events"]
        assert len(segments) <= 3
        if not segments[-1].endswith("whole"):
            assert spark.read.parquet(f"file://{tmp_path}/store/{segments[-1]}").count() == 1
    assert store.read("events").count() == 100 and amounts(store.read("balances")) == {("base", "a0", ""): 10, ("base", "a1", ""): 20, ("base", "a2", ""): 20}
    left = [p.name for p in (tmp_path / "store" / "events").iterdir() if not p.name.startswith(".")]
    assert len(left) <= 7  # what the last two versions name


def test_a_batch_that_fails_as_a_whole_is_an_error(spark):
    import pytest

    from ledgerloom.operators import canonical

    df = spark.createDataFrame([("base", 0, 3)], "chain string, done long, n long")
    with pytest.raises(Exception, match="no transaction"):
        canonical.guarded(df, F.col("done"), F.col("n")).collect()
