"""Canonicalisation: duplicates, carry-over, fees, ownership, coverage, finality of results.

Every "replace if better" rule is a total order, so one window rank per key finds the winner that folding pair by pair would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalar as S
from ledgerloom.operators.dedup import pick_first, pick_winner

# Metadata keys that may name the finality (on slot-based chains in another order) and the data fee, in order.
FINALITY_KEYS = ("finality_state", "finality", "confirmation_status", "commitment")
FINALITY_KEYS_BY_SLOT = ("commitment", "confirmation_status", "finality_state", "finality")
DATA_FEE_KEYS = ("fee_data_l1", "data_fee_l1", "l1_data_fee", "l1_fee")


def signatures(df: DataFrame) -> DataFrame:
    """N1 over (chain, tx_hash, sequence): per identity the largest sequence, then the smallest hash."""
    named = df.withColumn("identity", S.signature_identity("chain", "tx_hash"))
    return pick_winner(named, ["chain", "identity"], [F.col("sequence").desc(), F.col("tx_hash")])


def fetched_signatures(df: DataFrame) -> DataFrame:
    """N2 over (chain, tx_hash, sequence, block_time): as N1, but a known and later time goes before the hash."""
    named = df.withColumn("identity", S.signature_identity("chain", "tx_hash"))
    return pick_winner(named, ["chain", "identity"], [F.col("sequence").desc(), F.col("block_time").desc_nulls_last(), F.col("tx_hash")])


def up_to_cutoff(df: DataFrame, cutoff: Column, cursor: Column) -> DataFrame:
    """Rows up to the cutoff whose identity is not the cursor's, without duplicates."""
    own = S.signature_identity("chain", "tx_hash")
    return fetched_signatures(df.where((F.col("sequence") <= cutoff) & ~own.eqNullSafe(S.cursor_value("chain", cursor))))


def carried_over(df: DataFrame, cursor_sequence: int, batch: int) -> DataFrame:
    """N5 over (chain, tx_hash, sequence), by chain: the first `batch` rows after the cursor by sequence and hash; what they leave of the
    batch from the cursor's own sequence by descending hash; all rows where none reaches the cursor, or without a cursor.

    Both ranks are cut at `batch` before the shuffle, so a chain's rows never meet in one task; the counts are one row a chain.
    """
    if cursor_sequence <= 0:
        return df
    batch, at = max(1, batch), F.col("sequence")
    newer = pick_first(df.where(at > cursor_sequence), ["chain"], [at, F.col("tx_hash")], batch)
    own = pick_first(df.where(at == cursor_sequence), ["chain"], [F.col("tx_hash").desc()], batch, "_place")
    counts = df.groupBy("chain").agg(F.max("sequence").alias("_top"), F.count(F.when(at > cursor_sequence, 1)).alias("_after"))
    kept = own.join(counts, "chain").where(F.col("_place") <= batch - F.col("_after")).select(*df.columns)
    idle = df.where(at < cursor_sequence).join(counts.where(F.col("_top") < cursor_sequence).select("chain"), "chain", "left_semi")
    return newer.unionByName(kept).unionByName(idle.select(*df.columns))


def self_transfers(df: DataFrame) -> DataFrame:
    """N7 over (chain, category, address, counterparty, activity, action, delta)."""
    own = (F.col("category") == "TRANSFER") & (F.col("address") == F.col("counterparty")) & (F.col("address") != "") & (F.col("chain") != "btc")
    return df.withColumns({"activity": F.when(own, "SELF_TRANSFER").otherwise(F.col("activity")), "action": F.when(own, "self_transfer").otherwise(F.col("action")), "delta": F.when(own, "0").otherwise(F.col("delta"))})


def emits_fee(status: Column | str, payer: Column | str, amount: Column | str, watched: Column) -> Column:
    """Whether a transaction's fee becomes an event."""
    n = S.magnitude(amount)
    return F.upper(S.col(status)).isin("SUCCESS", "FAILED") & (S.stripped(payer) != "") & F.coalesce(n != 0, F.lit(False)) & watched


def missing_fees(txs: DataFrame, events: DataFrame) -> DataFrame:
    """Transactions whose payer has no FEE event yet (keys tx_hash and fee_payer / address)."""
    paid = events.where("category = 'FEE'").select("tx_hash", F.col("address").alias("fee_payer")).distinct()
    return txs.join(paid, ["tx_hash", "fee_payer"], "left_anti")


def split_fees(df: DataFrame) -> DataFrame:
    """N10 and N11 over (chain, tx_hash, fee_amount, metadata): one FEE, or on layer-2 chains execution and data fees.

    The execution fee is named, or gas times price, or the whole; the data fee is the first named one, else marked missing.
    """
    m = F.col("metadata")
    named = lambda key: S.integer(F.trim(F.element_at(m, key)))
    data = F.coalesce(*[named(k) for k in DATA_FEE_KEYS])
    product = (named("gas_used") * named("effective_gas_price")).cast("decimal(38,0)")
    known = F.coalesce(named("fee_execution_l2"), product)
    total = S.magnitude("fee_amount")
    parts = df.withColumns({"_l2": F.col("chain").isin(*S.L2_CHAINS), "_exec": F.coalesce(known, total), "_data": data, "_total": total, "_known": known})
    mismatch = F.col("_known").isNotNull() & F.col("_data").isNotNull() & (F.col("_known") + F.col("_data") != F.col("_total"))

    def part(kind: str, amount: Column, when: Column) -> Column:
        return F.when(when & (amount != 0), F.struct(F.lit(kind).alias("activity"), S.fee_delta(amount.cast("string")).alias("delta")))

    made = F.array_compact(F.array(part("FEE", F.col("_total"), ~F.col("_l2")), part("FEE_EXECUTION_L2", F.col("_exec"), F.col("_l2")), part("FEE_DATA_L1", F.col("_data"), F.col("_l2"))))
    marked = parts.select("chain", "tx_hash", F.explode(made).alias("_fee"), (F.col("_l2") & F.coalesce(mismatch, F.lit(False))).alias("fee_total_mismatch"), (F.col("_l2") & F.col("_data").isNull()).alias("data_fee_l1_unavailable"))
    return marked.select("chain", "tx_hash", "_fee.*", "fee_total_mismatch", "data_fee_l1_unavailable")


def gated_btc_fees(events: DataFrame, txs: DataFrame) -> DataFrame:
    """Transactions whose fee still has to be booked. It is there already, as an output, where an input was spent, someone
    other than the payer received something, and the payer got back exactly the fee."""
    spent, got = F.col("action") == "vin_spend", F.col("action") == "vout_receive"
    amount, own = S.magnitude("delta"), F.trim("address") == F.trim("fee_payer")
    joined = events.where("activity in ('DEPOSIT', 'WITHDRAWAL')").join(txs.select("tx_hash", "fee_payer", "fee_amount"), "tx_hash")
    some = lambda c: F.max(F.coalesce(c, F.lit(False)))
    seen = joined.groupBy("tx_hash").agg(some(spent).alias("a"), some(got & ~own & (amount != 0)).alias("b"), some(got & own & (amount != 0) & (amount == S.magnitude("fee_amount"))).alias("c"))
    return txs.join(seen.where("a and b and c").select("tx_hash"), "tx_hash", "left_anti")


def owned_by_outer(events: DataFrame) -> DataFrame:
    """Inner instructions (tx_hash, outer, inner, address, asset, activity) of which the outer instruction has an own event
    move to the outer one (inner -1); `from_outer` tells the origin."""
    keys = ["tx_hash", "outer", "address", "asset", "activity"]
    owners = events.where("inner = -1").select(*keys).distinct().withColumn("_owned", F.lit(True))
    joined = events.join(owners, keys, "left")
    return joined.select(*[c for c in events.columns if c != "inner"], F.col("inner").alias("original_inner"), F.when(F.col("_owned"), -1).otherwise(F.col("inner")).alias("inner"), (F.col("inner") == -1).alias("from_outer"))


def solana_winners(events: DataFrame) -> DataFrame:
    """One event per event_id."""
    fee = F.col("activity").startswith("FEE")
    order = [S.rank_norm("finality_state").desc(), F.when(~fee, F.when(F.col("from_outer"), 0).otherwise(1)), F.when(~fee, F.col("original_inner")), F.col("action"), F.when(~fee, F.col("contract")), S.delta_order("delta"), F.col("ordinal")]
    return pick_winner(events, ["event_id"], order)


def account_winners(events: DataFrame) -> DataFrame:
    """One event per event_id: best finality, then action, contract, counterparty and delta."""
    return pick_winner(events, ["event_id"], [S.rank_norm("finality_state").desc(), F.col("action"), F.col("contract"), F.col("counterparty"), S.delta_order("delta"), F.col("ordinal")])


def result_finality(events: DataFrame) -> DataFrame:
    """N18 over (chain, tx_hash, metadata): the strongest finality that any event's metadata names, earlier keys first on ties."""

    def named(keys: tuple[str, ...]) -> Column:
        return F.array(*[F.struct(S.rank_norm(F.element_at("metadata", k)).alias("rank"), F.lit(-i).alias("place"), S.finality(F.element_at("metadata", k)).alias("state")) for i, k in enumerate(keys)])

    by_chain = F.when(F.col("chain") == "solana", named(FINALITY_KEYS_BY_SLOT)).otherwise(named(FINALITY_KEYS))
    best = events.select("chain", "tx_hash", F.array_max(by_chain).alias("best")).groupBy("chain", "tx_hash").agg(F.max("best").alias("best"))
    return best.select("chain", "tx_hash", F.when(F.col("best.rank") > 0, F.col("best.state")).otherwise(S.default_finality("chain")).alias("finality_state"))


def coverage(events: DataFrame) -> DataFrame:
    """The union of all decodings' events by (path, address, asset, category); the fullest one wins."""
    order = [F.col("path_hinted").desc(), F.col("n_metadata").desc(), F.col("n_filled").desc(), F.col("fingerprint"), F.col("ordinal")]
    return pick_winner(events, ["tx_hash", "path", "address", "asset", F.upper("category")], order)


def decode_results(results: DataFrame) -> DataFrame:
    """N19 over (identity, block_cursor, finality_state, status, fee_amount, fee_payer, tx_hash, n_events, ordinal): the best result of a signature."""
    order = [F.col("block_cursor").desc(), S.rank_norm("finality_state").desc(), (F.upper("status") != "SUCCESS"), F.col("status"), F.col("fee_amount"), F.col("fee_payer"), F.col("tx_hash"), F.col("n_events").desc(), F.col("ordinal")]
    return pick_winner(results, ["identity"], order)


def alias_collapsed(events: DataFrame) -> DataFrame:
    """Of events alike in category, address, asset, counterparty and delta, exactly one with a path and some without:
    the pathless ones go and their metadata fill the other's gaps."""
    lineage = Window.partitionBy("tx_hash", "category", "address", "asset", "counterparty", "delta")
    seen = events.withColumns({"_hinted": F.count(F.when(F.col("path_hinted"), 1)).over(lineage), "_bare": F.count(F.when(~F.col("path_hinted"), 1)).over(lineage)})
    entries = F.flatten(F.collect_list(F.when(~F.col("path_hinted"), F.map_entries("metadata"))).over(lineage))
    one = (F.col("_hinted") == 1) & (F.col("_bare") >= 1)
    # of several values for one key the least counts, so the order of events does not matter
    keys = F.array_distinct(F.transform("_entries", lambda e: e["key"]))
    rest = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.array_min(F.transform(F.filter("_entries", lambda e: e["key"] == k), lambda e: e["value"])))))
    merged = F.when(one, S.overlaid(rest, F.col("metadata"))).otherwise(F.col("metadata"))
    return seen.withColumn("_entries", entries).where(~one | F.col("path_hinted")).withColumn("metadata", merged).drop("_hinted", "_bare", "_entries")


def matched_results(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Each expected signature (identity) with its result (identity, error): ok, failed, missing or unexpected."""
    both = expected.select("identity", F.lit(True).alias("_wanted")).join(results.select("identity", "error", F.lit(True).alias("_got")), "identity", "full_outer")
    kind = F.when(F.col("_wanted").isNull(), "unexpected").when(F.col("_got").isNull(), "missing").when(F.col("error").isNotNull(), "failed").otherwise("ok")
    return both.select("identity", kind.alias("outcome"))


def decode_errors(errors: DataFrame) -> DataFrame:
    """N24 over (identity, class, reason): transient beats terminal per signature, the smallest reason of that class counts."""
    best = errors.groupBy("identity").agg(F.min(F.struct((F.col("class") != "transient").alias("terminal"), "reason")).alias("b"))
    return best.select("identity", F.when(F.col("b.terminal"), "terminal").otherwise("transient").alias("class"), F.col("b.reason").alias("reason"))


def cursor_advance(processed: DataFrame) -> DataFrame:
    """N26 over (chain, network, sequence, value): the largest (sequence, value)."""
    best = processed.groupBy("chain", "network").agg(F.max(F.struct("sequence", "value")).alias("b"))
    return best.select("chain", "network", "b.sequence", "b.value")


def guarded(df: DataFrame, processed: Column, total: Column) -> DataFrame:
    """Fails a batch of which nothing could be processed."""
    return df.where(F.when((processed == 0) & (total > 0), F.raise_error(F.lit("no transaction of the batch could be decoded"))).otherwise(F.lit(True)))


def reconciled_fees(events: DataFrame) -> DataFrame:
    """N12 over fee events (tx_hash, path, metadata, fingerprint): one execution and one data fee per transaction.

    The best event that names both parts gives both; else each part comes from the best event that names it. Better is: with a
    path, with more metadata, with the smaller fingerprint. The path is the chosen event's, else the best one's that has any.
    """
    m = F.col("metadata")
    named = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.element_at(m, k)), F.lit("")) for k in keys])
    given = F.nullif(F.trim("path"), F.lit(""))
    rows = events.select("tx_hash", named("fee_execution_l2").alias("e"), named(*DATA_FEE_KEYS).alias("d"), given.alias("p"), F.struct(F.when(given.isNull(), 1).otherwise(0), -F.size("metadata"), "fingerprint").alias("o"))
    both = F.col("e").isNotNull() & F.col("d").isNotNull()
    best = lambda value, when: F.min_by(value, F.when(when, F.col("o")))
    picked = rows.groupBy("tx_hash").agg(
        best(F.struct("e", "d", "p"), both).alias("b"), best(F.struct("e", "p"), F.col("e").isNotNull()).alias("x"), best(F.struct("d", "p"), F.col("d").isNotNull()).alias("y"), best("p", F.col("p").isNotNull()).alias("path"),
        F.max(both).alias("some_both"),
    )
    either = lambda whole, part: F.when(F.col("some_both"), whole).otherwise(part)
    return picked.select("tx_hash", either(F.col("b.e"), F.col("x.e")).alias("fee_execution_l2"), either(F.col("b.d"), F.col("y.d")).alias("fee_data_l1"), F.coalesce(either(F.col("b.p"), F.coalesce("x.p", "y.p")), F.col("path")).alias("path"))


def floored(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """N22 in batch: a batch's events with those that the ledger knows of the same signatures, so nothing is ever lost."""
    known = ledger.join(events.select("tx_hash").distinct(), "tx_hash", "left_semi")
    return coverage(events.unionByName(known.select(*events.columns)))


def sentinels(batches: DataFrame) -> DataFrame:
    """N27 over (chain, network, end_block, n_signatures): empty batches, which only move the watermark."""
    return batches.where("n_signatures = 0").groupBy("chain", "network").agg(F.max("end_block").alias("ingested_sequence"))


def normalised(decoded: DataFrame, watched: DataFrame, network: str, block_times: DataFrame | None = None) -> DataFrame:
    """N6, N14, N28 over decoded events (chain, tx_hash, block_cursor, event_path, address, counterparty, contract, category, action, delta,
    token_type, finality_state): canonical events of watched parties. `block_times` (tx_hash, block_time) fills times in the live path
    only; a replay leaves it out."""
    own = decoded.join(watched.select("address").distinct(), "address", "left_semi")
    named = own.withColumns({"network": F.lit(network), "activity": S.activity("category", "delta"), "identity": S.signature_identity("chain", "tx_hash")})
    moved = self_transfers(named)
    ids = moved.withColumn("event_id", S.event_id("chain", "network", "identity", "event_path", "address", "contract", "activity")).withColumn("ordinal", F.struct("tx_hash", "event_path"))
    out = account_winners(ids)
    return out if block_times is None else out.join(block_times, "tx_hash", "left")
