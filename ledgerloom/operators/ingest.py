"""Ingestion: from canonical events to ledger rows, balances, blocks and watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalar as S
from ledgerloom.operators.dedup import pick_winner, upserted

BALANCE_KEY = ["chain", "network", "address", "contract", "balance_type"]


def first_transactions(df: DataFrame) -> DataFrame:
    """G1: the first transaction of each identity by ordinal."""
    return pick_winner(df.withColumn("identity", S.signature_identity("chain", "tx_hash")), ["chain", "network", "identity"], [F.col("ordinal")])


def first_tokens(events: DataFrame) -> DataFrame:
    """The event that defines a token is the first one of its contract."""
    return pick_winner(events, ["chain", "network", "contract"], [F.col("ordinal")])


def failed_fees(txs: DataFrame, events: DataFrame) -> DataFrame:
    """Failed transactions without events still pay: one FEE each, whoever the payer is."""
    digits = S.integer("fee_amount")
    paying = txs.where((F.col("status") == "FAILED") & (S.stripped("fee_payer") != "") & F.coalesce(digits > 0, F.lit(False))).join(events.select("chain", "network", "tx_hash").distinct(), ["chain", "network", "tx_hash"], "left_anti")
    return paying.select("chain", "network", "tx_hash", F.concat(F.lit("fee:"), "chain", F.lit(":"), "tx_hash").alias("event_id"), F.col("fee_payer").alias("address"), F.concat(F.lit("-"), "fee_amount").alias("delta"), F.lit("FEE").alias("activity"), F.lit("").alias("finality_state"))


def without_denied(events: DataFrame, tokens: DataFrame) -> DataFrame:
    """G4."""
    return events.join(tokens.where("is_denied").select("chain", "network", "contract"), ["chain", "network", "contract"], "left_anti")


def applies(chain: Column, finality: Column, token_type: Column, delta: Column) -> Column:
    """Whether an event moves a balance at once."""
    final = (chain == "solana") | (S.rank_ingest(finality) >= 2)
    moves = F.coalesce(S.stripped(delta).rlike("^[+-]?0*[1-9][0-9]*$"), F.lit(False))
    return final & ((token_type == "NATIVE") | moves)


def scam_denials(events: DataFrame, balances: DataFrame) -> DataFrame:
    """Events (chain, network, address, contract, token_type, delta, signal, applied, ordinal) with `deny_ordinal`, the first
    one at which the contract gives itself away, and `skipped`, whether a denial came before.

    Before its first firing event nothing of a contract is skipped, so firing can be told without regard to denial.
    """
    held = balances.select("chain", "network", "address", "contract").distinct().withColumn("_held", F.lit(True))
    before = Window.partitionBy("chain", "network", "address", "contract").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("chain", "network", "contract")
    joined = events.join(held, ["chain", "network", "address", "contract"], "left")
    exists = F.coalesce(F.col("_held"), F.lit(False)) | F.coalesce(F.max("applied").over(before), F.lit(False))
    judged = (F.col("token_type") != "NATIVE") & (F.col("chain") != "btc")
    fires = judged & ((F.coalesce(F.col("signal"), F.lit("")) != "") | ((F.coalesce(S.integer("delta"), F.lit(0)) < 0) & ~exists))
    marked = joined.withColumn("_fires", fires).withColumn("deny_ordinal", F.min(F.when(F.col("_fires"), F.col("ordinal"))).over(own))
    return marked.withColumn("skipped", F.coalesce(F.col("ordinal") >= F.col("deny_ordinal"), F.lit(False))).drop("_held", "_fires")


def running_balances(events: DataFrame, balances: DataFrame | None = None) -> DataFrame:
    """Events (chain, network, address, contract, delta_n, applied, ordinal) with balance_before and balance_after; null where not applied."""
    keys = ["chain", "network", "address", "contract"]
    moved = F.when(F.col("applied"), F.col("delta_n")).otherwise(0)
    so_far = F.sum(moved).over(Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    start = F.lit(0)
    if balances is not None:
        events = events.join(balances.where("balance_type = ''").select(*keys, F.col("amount").alias("_start")), keys, "left")
        start = F.coalesce(F.col("_start"), F.lit(0))
    after = (so_far + start).cast("decimal(38,0)")
    out = events.withColumn("_after", after)
    return out.withColumn("balance_before", F.when(F.col("applied"), F.col("_after") - F.col("delta_n")).cast("decimal(38,0)")).withColumn("balance_after", F.when(F.col("applied"), F.col("_after"))).drop("_after", "_start")


def resolved_watch(events: DataFrame, watched: DataFrame) -> DataFrame:
    """The watched party of each event: its address, else its counterparty; with wallet and organisation."""
    names = watched.select("chain", "network", F.col("address").alias("_at"), "wallet_id", "organization_id")
    own = events.join(names.select("chain", "network", F.col("_at").alias("address"), F.col("wallet_id").alias("_w1"), F.col("organization_id").alias("_o1"), F.lit(True).alias("_hit1")), ["chain", "network", "address"], "left")
    other = own.join(names.select("chain", "network", F.col("_at").alias("counterparty"), F.col("wallet_id").alias("_w2"), F.col("organization_id").alias("_o2"), F.lit(True).alias("_hit2")), ["chain", "network", "counterparty"], "left")
    pick = lambda a, b: F.when(F.col("_hit1"), a).when(F.col("_hit2"), b)
    return other.withColumns({"watched_address": pick(F.col("address"), F.col("counterparty")), "wallet_id": pick(F.col("_w1"), F.col("_w2")), "organization_id": pick(F.col("_o1"), F.col("_o2"))}).drop("_w1", "_o1", "_w2", "_o2", "_hit1", "_hit2")


def mirrored(events: DataFrame) -> DataFrame:
    """G10 and G11 before summing: each applied event's change of the liquid balance, and for staking the opposite of the staked one."""
    row = lambda kind, sign: F.struct(F.lit(kind).alias("balance_type"), (F.col("delta_n") * sign).cast("decimal(38,0)").alias("change"))
    changes = F.when(S.is_staking("activity"), F.array(row("", 1), row("staked", -1))).otherwise(F.array(row("", 1)))
    return events.select("*", F.explode(changes).alias("_c")).select(*events.columns, "_c.*")


def adjustments(events: DataFrame) -> DataFrame:
    """G10 over applied events: sum by balance key, the newest cursor and the hash that first reached it. Always by the whole table key."""
    latest = F.min_by("tx_hash", F.struct(-F.col("block_cursor"), "ordinal"))
    return mirrored(events).groupBy(*BALANCE_KEY).agg(F.sum("change").cast("decimal(38,0)").alias("amount"), F.max("block_cursor").alias("last_updated_cursor"), latest.alias("last_updated_tx_hash"))


def adjusted(balances: DataFrame, changes: DataFrame) -> DataFrame:
    """Balances with changes added; new keys are inserted; the cursor only grows."""
    newer = F.col("n.last_updated_cursor") >= F.col("o.last_updated_cursor")
    return upserted(balances, changes, BALANCE_KEY, {
        "amount": (F.col("o.amount") + F.col("n.amount")).cast("decimal(38,0)"),
        "last_updated_cursor": F.greatest("o.last_updated_cursor", "n.last_updated_cursor"),
        "last_updated_tx_hash": F.when(newer, F.col("n.last_updated_tx_hash")).otherwise(F.col("o.last_updated_tx_hash")),
    })


def prefetched(keys: DataFrame, balances: DataFrame) -> DataFrame:
    """Amount (0 if none) and whether the row exists, for each wanted key."""
    got = keys.join(balances.select(*BALANCE_KEY, "amount", F.lit(True).alias("_there")), BALANCE_KEY, "left")
    return got.select(*BALANCE_KEY, F.coalesce("amount", F.lit(0)).cast("decimal(38,0)").alias("amount"), F.coalesce("_there", F.lit(False)).alias("is_there"))


def upserted_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger after an upsert of one row per event_id: only where the new finality is no weaker; amounts never change."""
    wins = S.rank_store(F.col("n.finality_state")) >= S.rank_store(F.col("o.finality_state"))
    given = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}"))
    rules = {
        "finality_state": F.col("n.finality_state"), "balance_applied": F.col("o.balance_applied") | F.col("n.balance_applied"), "block_hash": given("block_hash"),
        "tx_index": F.when(F.col("n.tx_index") != 0, F.col("n.tx_index")).otherwise(F.col("o.tx_index")), "block_cursor": F.greatest("o.block_cursor", "n.block_cursor"),
        "block_time": F.greatest("o.block_time", "n.block_time"), "chain_data": F.coalesce("n.chain_data", "o.chain_data"), "decoder_version": given("decoder_version"), "schema_version": given("schema_version"),
    }
    return upserted(old, new, ["event_id"], {c: F.when(wins, v).otherwise(F.col(f"o.{c}")) for c, v in rules.items() if c in old.columns})


def upsert_outcomes(old: DataFrame, new: DataFrame) -> DataFrame:
    """G13 per chain: how many rows are inserted, updated, kept, and how many become applied by crossing the finality gate."""
    both = new.alias("n").join(old.alias("o"), F.col("n.event_id") == F.col("o.event_id"), "left")
    there, wins = F.col("o.event_id").isNotNull(), S.rank_store(F.col("n.finality_state")) >= S.rank_store(F.col("o.finality_state"))
    tally = lambda c: F.count(F.when(c, 1))
    return both.groupBy(F.col("n.chain").alias("chain")).agg(tally(~there).alias("inserted"), tally(there & wins).alias("updated"), tally(there & ~wins).alias("kept"), tally(there & wins & F.col("n.balance_applied") & ~F.col("o.balance_applied")).alias("crossed"))


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first writer wins."""
    return old.unionByName(pick_winner(new, keys, order).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def indexed_blocks(old: DataFrame, txs: DataFrame) -> DataFrame:
    """Blocks of transactions that carry a hash; the last write wins."""
    seen = pick_winner(txs.where(F.coalesce(F.col("block_hash"), F.lit("")) != ""), ["chain", "network", "block_number"], [F.col("ordinal").desc()])
    return upserted(old, seen.select(*old.columns), ["chain", "network", "block_number"], {c: F.col(f"n.{c}") for c in old.columns})


def watermarks(old: DataFrame, new: DataFrame, rewind: bool = False) -> DataFrame:
    """Watermarks (chain, network, ingested_sequence) only advance, unless a rewind sets them."""
    at = new.groupBy("chain", "network").agg(F.max("ingested_sequence").alias("ingested_sequence"))
    return upserted(old, at, ["chain", "network"], {"ingested_sequence": F.col("n.ingested_sequence") if rewind else F.greatest("o.ingested_sequence", "n.ingested_sequence")})


def drifted(prev_sequence: Column, prev_value: Column, new_sequence: Column, new_value: Column, chain: Column, n_txs: Column) -> Column:
    """Whether a batch contradicts the committed position: behind it, or at it with another identity and nothing new.
    Without both values, or before anything was committed, it can't."""
    known = prev_value.isNotNull() & new_value.isNotNull() & (prev_sequence != 0)
    name = lambda v: F.coalesce(S.cursor_value(chain, v), S.stripped(v))
    other = name(prev_value) != name(new_value)
    return F.coalesce(known & ((new_sequence < prev_sequence) | ((new_sequence == prev_sequence) & other & (n_txs == 0))), F.lit(False))


def fork_cursor(prev_sequence: Column, new_sequence: Column, floor: Column) -> Column:
    """The position to roll back to: the new one where it lies behind, or on the UTXO chain the lowest block of the
    competing branch (`floor`) if that is lower still; else the committed one."""
    lower = F.when((floor > 0) & (floor < new_sequence), floor)
    return F.when(new_sequence < prev_sequence, F.coalesce(lower, new_sequence)).otherwise(prev_sequence)


def advances(prev_sequence: Column, prev_value: Column, new_sequence: Column, new_value: Column, n_txs: Column) -> Column:
    """Whether a batch moves the checkpoint: it has transactions, another sequence, or another value."""
    return (n_txs > 0) | (new_sequence != prev_sequence) | ~new_value.eqNullSafe(prev_value)


def interleaved(commits: DataFrame, order: tuple[str, ...] = ("solana", "base", "btc")) -> DataFrame:
    """Commits (chain, ordinal) in turns: each chain's n-th before any chain's next."""
    turn = F.row_number().over(Window.partitionBy("chain").orderBy("ordinal"))
    place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in order]), F.col("chain")), F.lit(0))
    return commits.withColumns({"turn": turn, "seat": F.when(place == 0, len(order) + 1).otherwise(place)})


def committed(watermark: Column, expected: Column) -> Column:
    """After an unclear commit, whether it went through."""
    return F.coalesce(watermark >= expected, F.lit(False))


def oldest_block_time(batch: DataFrame) -> DataFrame:
    """G27."""
    return batch.groupBy("chain", "network").agg(F.min("block_time").alias("oldest_block_time"))


def competing_floor(batch: DataFrame) -> DataFrame:
    """The lowest block of a batch of the UTXO chain; only it replays competing branches."""
    return batch.where("chain = 'btc' and block_cursor > 0").groupBy("chain", "network").agg(F.min("block_cursor").alias("floor"))


def looked_up(addresses: DataFrame, watched: DataFrame) -> DataFrame:
    """L1 and L2: which addresses are watched. Spark prunes the large side by a runtime Bloom filter of the small one where that pays."""
    hit = watched.select("chain", "network", "address", F.lit(True).alias("_hit")).distinct()
    return addresses.join(hit, ["chain", "network", "address"], "left").withColumn("is_watched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def deny_log(denials: DataFrame, tokens: DataFrame, source: str = "auto", score: int = 100) -> DataFrame:
    """The audit rows of the tokens that scam_denials() denies now: contract, reason (the signal of the event that gave it away), source,
    score and the event's position. Tokens that were denied before have no new row."""
    at = F.col("ordinal") == F.col("deny_ordinal")
    reason = F.coalesce(F.nullif("signal", F.lit("")), F.lit("phantom_withdrawal"))
    first = denials.where(at).groupBy("chain", "network", "contract").agg(F.min(F.struct("ordinal", reason.alias("reason"))).alias("f"))
    known = tokens.where("is_denied").select("chain", "network", "contract")
    return first.join(known, ["chain", "network", "contract"], "left_anti").select("chain", "network", "contract", "f.reason", F.lit(source).alias("source"), F.lit(score).alias("score"), F.col("f.ordinal").alias("denied_at"))


def with_denied(tokens: DataFrame, log: DataFrame) -> DataFrame:
    """Tokens after the denials of a batch."""
    now = log.select("chain", "network", "contract", F.lit(True).alias("_now")).distinct()
    both = tokens.join(now, ["chain", "network", "contract"], "left")
    return both.withColumn("is_denied", F.col("is_denied") | F.coalesce("_now", F.lit(False))).drop("_now")
