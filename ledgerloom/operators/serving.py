"""Serving queries over ledger, balances and reference tables (Q1-Q20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.dedup import pick_winner, upserted

PAGE, MOST = 50, 200


def balance_rows(watched: DataFrame, balances: DataFrame, tokens: DataFrame) -> DataFrame:
    """Q1, flat: active watched addresses with their balances and tokens; an address without balances has one row of defaults."""
    b = balances.select("chain", "network", "address", "contract", "balance_type", "amount")
    t = tokens.select("chain", "network", "contract", "symbol", "decimals")
    joined = watched.where("is_active").select("chain", "network", "address", "label").join(b, ["chain", "network", "address"], "left").join(t, ["chain", "network", "contract"], "left")
    return joined.select("chain", "network", "address", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("symbol", F.lit("")).alias("symbol"), F.coalesce("decimals", F.lit(0)).alias("decimals"), F.coalesce("balance_type", F.lit("")).alias("balance_type"), F.coalesce(F.col("amount").cast("string"), F.lit("0")).alias("amount"))


def balance_summary(watched: DataFrame, balances: DataFrame, tokens: DataFrame) -> DataFrame:
    """Q1, folded: one row per address; rows with a blank symbol are hidden, but their address stays."""
    entry = F.when(F.col("symbol") != "", F.struct("symbol", "balance_type", "amount", "decimals"))
    return balance_rows(watched, balances, tokens).groupBy("chain", "network", "address").agg(F.first("label").alias("label"), F.sort_array(F.collect_list(entry)).alias("balances"))


def recent_events(events: DataFrame, tokens: DataFrame, chain: str, network: str, address: str | None = None, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """Q2: a page of newest events with the number of all; limits outside 1..200 count as 50, negative offsets as 0."""
    limit, offset = limit if 1 <= limit <= MOST else PAGE, max(0, offset)
    own = events.where((F.col("chain") == chain) & (F.col("network") == network))
    if address is not None:
        own = own.where(F.col("address") == address)
    total = own.agg(F.count("*").alias("total"))  # one row; a window over all rows would gather them in one task
    page = own.orderBy(F.col("block_cursor").desc(), "event_id").offset(offset).limit(limit)
    named = page.join(tokens.select("chain", "network", "contract", "symbol"), ["chain", "network", "contract"], "left")
    return named.crossJoin(F.broadcast(total))


def overview(watermarks: DataFrame, watched: DataFrame) -> DataFrame:
    """Q3, Q4 and Q5."""
    return watermarks.crossJoin(F.broadcast(watched.where("is_active").agg(F.count("*").alias("active_addresses")))).orderBy("chain", "network")


def events_in_range(events: DataFrame, chain: str, network: str, first: int, last: int) -> DataFrame:
    """Q6, in order of block, transaction and path, ties by hash and id."""
    return events.where((F.col("chain") == chain) & (F.col("network") == network) & F.col("block_cursor").between(first, last)).orderBy("block_cursor", "tx_index", "event_path", "tx_hash", "event_id")


def balances_of(balances: DataFrame, chain: str, network: str, address: str) -> DataFrame:
    """Q7."""
    return balances.where((F.col("chain") == chain) & (F.col("network") == network) & (F.col("address") == address))


def active_watched(watched: DataFrame, chain: str | None = None) -> DataFrame:
    """Q8."""
    out = watched.where("is_active")
    return (out if chain is None else out.where(F.col("chain") == chain)).orderBy("created_at", "address")


def by_key(df: DataFrame, **key) -> DataFrame:
    """Q9 and Q13: rows with these values."""
    for c, v in key.items():
        df = df.where(F.col(c).eqNullSafe(F.lit(v)))
    return df


def denied(wanted: DataFrame, tokens: DataFrame) -> DataFrame:
    """Q10: for each wanted contract, whether it is denied; unknown ones are not."""
    return wanted.join(tokens.select("chain", "network", "contract", "is_denied"), ["chain", "network", "contract"], "left").withColumn("is_denied", F.coalesce("is_denied", F.lit(False)))


def found_in_book(book: DataFrame, chain: str, network: str, org_id: str, address: str) -> DataFrame:
    """Q11: the one active entry of an organisation for an address."""
    return by_key(book, chain=chain, network=network, org_id=org_id, address=address).where("status = 'ACTIVE'").orderBy("name").limit(1)


def book_upsert(book: DataFrame, entries: DataFrame) -> DataFrame:
    """Q11: keyed with the organisation."""
    return upserted(book, entries, ["chain", "network", "org_id", "address"], {"name": F.col("n.name"), "status": F.col("n.status")})


def book_delete(book: DataFrame, chain: str, network: str, address: str) -> DataFrame:
    """Q11: deletes an address whatever its organisation."""
    return book.where(~((F.col("chain") == chain) & (F.col("network") == network) & (F.col("address") == address)))


def active_configs(configs: DataFrame) -> DataFrame:
    """Q12: one map per target."""
    return configs.where("is_active").groupBy("chain", "network").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("config_key", "config_value")))).alias("configs"))


def watched_upsert(watched: DataFrame, entries: DataFrame) -> DataFrame:
    """Known addresses only change is_active."""
    return upserted(watched, entries, ["chain", "network", "address"], {"is_active": F.col("n.is_active")})


def prefixed_count(events: DataFrame, prefix: str) -> DataFrame:
    """Q15."""
    return events.where(F.col("tx_hash").startswith(prefix)).agg(F.count("*").alias("n"))


def negative_balances(balances: DataFrame) -> DataFrame:
    """Q16."""
    return balances.where("amount < 0")


def duplicate_hashes(txs: DataFrame) -> DataFrame:
    """Q17: hashes that stand more than once."""
    return txs.groupBy("chain", "network", "tx_hash").agg(F.count("*").alias("n")).where("n > 1")


def migrated_dedup(events: DataFrame) -> DataFrame:
    """Q18: the newest row of each non-blank event_id; rows without an id all stay."""
    blank = F.coalesce(F.col("event_id"), F.lit("")) == ""
    return pick_winner(events.where(~blank), ["event_id"], [F.col("created_at").desc(), F.col("block_time").desc(), F.col("id")]).unionByName(events.where(blank))


def legacy_transfers(transfers: DataFrame) -> DataFrame:
    """Q19 over (direction, amount): signed deltas and activities of old transfer rows."""
    out = F.col("direction") == "outgoing"
    return transfers.withColumns({"delta": F.when(out, -F.col("amount")).otherwise(F.col("amount")), "activity": F.when(out, "WITHDRAWAL").otherwise("DEPOSIT")})


def retention(events: DataFrame, today: Column, days: int) -> DataFrame:
    """Q20: whole days that are kept; a day is a partition of the stored ledger."""
    return events.where(F.to_date("block_time") >= F.date_sub(today, days))
