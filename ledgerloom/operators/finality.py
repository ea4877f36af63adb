"""Finality promotion, reorganisations, rollback and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalar as S
from ledgerloom.operators.ingest import BALANCE_KEY, mirrored


def promoted_blocks(blocks: DataFrame, up_to: Column) -> DataFrame:
    """R1."""
    return blocks.withColumn("finality_state", F.when(F.col("block_number") <= up_to, "finalized").otherwise(F.col("finality_state")))


def promoted_events(events: DataFrame, up_to: Column) -> DataFrame:
    """R2: events with their new state, and `newly_applied` where the promotion applied them. Events without a state stay."""
    near = F.col("block_cursor") <= up_to
    state = F.when(near & (F.col("finality_state") != ""), "finalized").otherwise(F.col("finality_state"))
    now = near & ~F.col("balance_applied") & (state == "finalized")
    return events.withColumns({"finality_state": state, "newly_applied": now, "balance_applied": F.col("balance_applied") | now})


def changes(events: DataFrame, sign: int = 1) -> DataFrame:
    """R3 (sign 1) and R10 (sign -1): summed balance changes of events, by the balance key."""
    return mirrored(events).groupBy(*BALANCE_KEY).agg((F.sum("change") * sign).cast("decimal(38,0)").alias("amount"))


def finality_triggers(heads: DataFrame, last: DataFrame, retention: int) -> DataFrame:
    """Chains whose finalized block passed the last one, and below which block finalized ones may go."""
    both = heads.join(last.select("chain", "network", F.col("finalized").alias("_last")), ["chain", "network"], "left")
    return both.where(F.col("finalized") > F.coalesce("_last", F.lit(-1))).select("chain", "network", "finalized", F.greatest(F.lit(0), F.col("finalized") - retention).alias("purge_before"))


def purged_blocks(blocks: DataFrame, cutoff: Column) -> DataFrame:
    """Without finalized blocks below the cutoff."""
    return blocks.where(~((F.col("finality_state") == "finalized") & (F.col("block_number") < cutoff)))


def unfinalized(blocks: DataFrame, most: int = 1000) -> DataFrame:
    """The newest blocks that are not final, ascending."""
    return blocks.where("finality_state <> 'finalized'").orderBy(F.col("block_number").desc(), "chain").limit(most).orderBy("block_number", "chain")


def parent_breaks(blocks: DataFrame) -> DataFrame:
    """Per chain the lowest block whose parent hash is not the hash of the block before it, where both are known.
    The report names the child as the fork and its own hash as the actual one."""
    before = blocks.select("chain", "network", (F.col("block_number") + 1).alias("block_number"), F.col("block_hash").alias("expected_hash"))
    joined = blocks.join(before, ["chain", "network", "block_number"]).where((F.col("parent_hash") != "") & (F.col("expected_hash") != "") & (F.col("parent_hash") != F.col("expected_hash")))
    first = joined.groupBy("chain", "network").agg(F.min(F.struct("block_number", "expected_hash", F.col("block_hash").alias("actual_hash"))).alias("f"))
    return first.select("chain", "network", F.col("f.block_number").alias("fork_block"), "f.expected_hash", "f.actual_hash")


def hash_mismatches(blocks: DataFrame, on_chain: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """Per chain the lowest block, not verified before, whose hash or parent differs on chain."""
    if verified is not None:
        blocks = blocks.join(verified.select("chain", "network", "block_number", "block_hash"), ["chain", "network", "block_number", "block_hash"], "left_anti")
    real = on_chain.select("chain", "network", "block_number", F.col("block_hash").alias("_hash"), F.col("parent_hash").alias("_parent"))
    both = blocks.join(real, ["chain", "network", "block_number"]).where((F.col("block_hash") != F.col("_hash")) | ((F.col("parent_hash") != "") & (F.col("_parent") != "") & (F.col("parent_hash") != F.col("_parent"))))
    return both.groupBy("chain", "network").agg(F.min_by(F.struct(F.col("block_number").alias("fork_block"), F.col("block_hash").alias("expected_hash"), F.col("_hash").alias("actual_hash")), "block_number").alias("f")).select("chain", "network", "f.*")


def from_fork(events: DataFrame, fork: Column) -> DataFrame:
    """Events at or after the fork."""
    return events.where(F.col("block_cursor") >= fork)


def reversals(events: DataFrame, fork: Column) -> DataFrame:
    """Balance changes that take applied events from the fork on back."""
    return changes(from_fork(events, fork).where("balance_applied"), -1)


def rolled_back(events: DataFrame, fork: Column, address: Column | None = None) -> DataFrame:
    """The ledger without events from the fork on, of all addresses or of one watched address."""
    gone = F.col("block_cursor") >= fork
    if address is not None:
        gone = gone & F.col("watched_address").eqNullSafe(address)
    return events.where(~gone)


def rewound(fork: Column) -> Column:
    """The watermark after a rollback."""
    return F.greatest(F.lit(0), fork - 1)


def purge_counts(events: DataFrame, txs: DataFrame, blocks: DataFrame, fork: int, force: bool = False) -> DataFrame:
    """By chain, what a purge from `fork` on would delete and reverse, and whether finalized rows forbid it."""
    tally = lambda df, at, name: df.where(F.col(at) >= fork).groupBy("chain", "network").agg(F.count("*").alias(name))
    hit = events.where(F.col("block_cursor") >= fork).groupBy("chain", "network").agg(F.count("*").alias("events"), F.count(F.when(F.col("balance_applied"), 1)).alias("reversed"), F.count(F.when(F.col("finality_state") == "finalized", 1)).alias("_final"))
    both = hit.join(tally(txs, "block_cursor", "transactions"), ["chain", "network"], "full_outer").join(tally(blocks, "block_number", "blocks"), ["chain", "network"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("chain", "network", zero("events"), zero("transactions"), zero("blocks"), zero("reversed"), ((F.coalesce("_final", F.lit(0)) > 0) & ~F.lit(force)).alias("refused"))


def keyset_page(df: DataFrame, key: str, after, size: int = 1000) -> DataFrame:
    """The next page by key."""
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def backfills(watched: DataFrame, starts: DataFrame) -> DataFrame:
    """Chains with active addresses that want earlier blocks: from where, and how many addresses ask."""
    wanted = watched.where("is_active and backfill_from_block is not null").groupBy("chain", "network").agg(F.min("backfill_from_block").alias("from_block"), F.count("*").alias("addresses"))
    return wanted.join(starts, ["chain", "network"]).where("from_block < start_block").select("chain", "network", "from_block", "addresses")


def cleared(watched: DataFrame, done: DataFrame) -> DataFrame:
    """Watched addresses after their chains' backfill began."""
    flags = done.select("chain", "network", F.lit(True).alias("_done")).distinct()
    both = watched.join(flags, ["chain", "network"], "left")
    return both.withColumn("backfill_from_block", F.when(F.col("_done"), None).otherwise(F.col("backfill_from_block"))).select(*watched.columns)


def canonical_block_window() -> Window:
    """Blocks of one chain in order."""
    return Window.partitionBy("chain", "network").orderBy("block_number")


def is_final_chain(chain: Column | str) -> Column:
    """R1-R8 leave out chains whose events are final on delivery."""
    return S.default_finality(chain) == "finalized"
