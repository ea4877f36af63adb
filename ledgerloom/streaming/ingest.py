"""Structured Streaming around the same operators: batch ingestion, windowed error rates, and the coverage floor.

`foreachBatch` runs the pure functions of `operators` over the state that the store holds; the stream's checkpoint keeps its
offsets, the store its version, so each batch counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators import canonical, finality, ingest
from ledgerloom.streaming.store import NEWEST, SUM, LedgerStore, Table

EVENTS = "event_id string, chain string, network string, address string, contract string, token_type string, activity string, tx_hash string, block_cursor long, delta string, finality_state string, balance_applied boolean"
BALANCES = "chain string, network string, address string, contract string, balance_type string, amount decimal(38,0), last_updated_cursor long, last_updated_tx_hash string"
WATERMARKS = "chain string, network string, ingested_sequence long"
SCHEMAS = {"events": EVENTS, "balances": BALANCES, "watermarks": WATERMARKS}
TABLES = {"events": Table(EVENTS, NEWEST, ("event_id",)), "balances": Table(BALANCES, SUM, tuple(ingest.BALANCE_KEY)), "watermarks": Table(WATERMARKS)}
INPUT = "event_id string, chain string, network string, address string, counterparty string, contract string, token_type string, action string, activity string, tx_hash string, block_cursor long, delta string, finality_state string, ordinal long"


def _numbered(events: DataFrame) -> DataFrame:
    return events.withColumns({"delta_n": F.col("delta").cast("decimal(38,0)"), "ordinal": F.col("event_id")})


def changes(state: dict[str, DataFrame], batch: DataFrame) -> dict[str, DataFrame]:
    """What a batch of canonical events changes: rows of the ledger by id, and changes to balances by key of the events that count from now on.

    An event counts once: its amount never changes, so it is booked when it is applied first. Nothing else of the ledger is written.
    """
    new = canonical.account_winners(batch.where("event_id <> ''")).withColumn("balance_applied", ingest.applies(F.col("chain"), F.col("finality_state"), F.col("token_type"), F.col("delta")))
    new = new.select(*state["events"].columns)
    old = state["events"].join(new.select("event_id"), "event_id", "left_semi").select(*state["events"].columns)
    rows = ingest.upserted_events(old, new)
    booked = rows.where("balance_applied").join(old.where("balance_applied").select("event_id"), "event_id", "left_anti")
    marks = batch.groupBy("chain", "network").agg(F.max("block_cursor").alias("ingested_sequence"))
    return {"events": rows, "balances": ingest.adjustments(_numbered(booked)), "watermarks": ingest.watermarks(state["watermarks"], marks)}


def next_state(state: dict[str, DataFrame], batch: DataFrame) -> dict[str, DataFrame]:
    """The whole tables after a batch."""
    new = changes(state, batch)
    kept = state["events"].join(new["events"].select("event_id"), "event_id", "left_anti").select(*state["events"].columns)
    return {"events": kept.unionByName(new["events"]), "balances": ingest.adjusted(state["balances"], new["balances"]), "watermarks": new["watermarks"]}


def promoted_state(state: dict[str, DataFrame], chain: str, network: str, up_to: int) -> dict[str, DataFrame]:
    """The tables after a finality promotion of one chain."""
    own = (F.col("chain") == chain) & (F.col("network") == network)
    now = finality.promoted_events(state["events"].where(own), F.lit(up_to)).select(*state["events"].columns)
    events = state["events"].where(~own).unionByName(now)
    applied = _numbered(events.where("balance_applied"))
    return {"events": events, "balances": ingest.adjustments(applied)}


def rolled_back_state(state: dict[str, DataFrame], chain: str, network: str, fork: int) -> dict[str, DataFrame]:
    """The tables after a reorganisation of one chain: nothing from the fork on."""
    own = (F.col("chain") == chain) & (F.col("network") == network)
    events = state["events"].where(~own).unionByName(finality.rolled_back(state["events"].where(own), F.lit(fork)))
    applied = _numbered(events.where("balance_applied"))
    marks = state["watermarks"].withColumn("ingested_sequence", F.when(own, F.least("ingested_sequence", finality.rewound(F.lit(fork)))).otherwise(F.col("ingested_sequence")).cast("long"))
    return {"events": events, "balances": ingest.adjustments(applied), "watermarks": marks}


def ingest_batch(store: LedgerStore, batch: DataFrame, batch_id: int) -> bool:
    """One micro-batch; False if it was committed before. What it writes follows the batch, not the ledger."""
    if batch_id <= store.current()["batch"]:
        return False
    batch.persist()
    try:
        return store.commit(batch_id, changes({name: store.read(name) for name in TABLES}, batch))
    finally:
        batch.unpersist()


def started(events: DataFrame, store: LedgerStore, checkpoint: str) -> StreamingQuery:
    """Ingests a stream of canonical events, all that is there and then stops."""
    return events.writeStream.foreachBatch(lambda df, i: ingest_batch(store, df, i) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def error_rates(signals: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Over a stream (chain, ts, is_error): calls and errors by chain and window; rows later than `late` are past their window."""
    return signals.withWatermark("ts", late).groupBy("chain", F.window("ts", width).alias("w")).agg(F.count("*").alias("calls"), F.count(F.when(F.col("is_error"), 1)).alias("errors")).select("chain", F.col("w.start").alias("window_start"), "calls", "errors")


FLOOR_STATE = "events string, at double"
FLOOR_OUTPUT = "signature string, n_events long, n_new long"


def coverage_floor(events: DataFrame, ttl_ms: int | None = 600_000) -> DataFrame:
    """N22 over a stream (signature, path, address, asset, category): how many events are known of a signature after each batch. A
    later, thinner decoding never loses events; a signature not seen for `ttl_ms` is forgotten. Without a limit of time the stream also ends by itself under an availableNow
    trigger; with one, Spark keeps running batches to look for timeouts."""

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = set(state.get[0].split("\n")) if state.exists else set()
        before = len(known)
        for f in frames:
            known |= set(f["path"] + "|" + f["address"] + "|" + f["asset"] + "|" + f["category"].str.upper())
        state.update(("\n".join(sorted(known)), 0.0))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"signature": [key[0]], "n_events": [len(known)], "n_new": [len(known) - before]})

    return events.groupBy("signature").applyInPandasWithState(run, FLOOR_OUTPUT, FLOOR_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout)
