"""Account-based chains: block scan and transaction decoding.

Payloads are JSON strings read with a fixed schema; quantities are hexadecimal strings. Watched addresses are a DataFrame,
joined on the address, so their number may grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.bignum import hex_to_decimal
from ledgerloom.operators.dedup import pick_winner
from ledgerloom.sources.shared import dropped, written

#: Fixed value: the first topic of token transfers as the payloads in use spell it; a parameter of decoding.
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55aebf9f4f7b8"
ZERO_ADDRESS = "0x" + "0" * 40

_TX = "struct<hash:string,blockNumber:string,transactionIndex:string,from:string,to:string,value:string,gasPrice:string>"
_LOG = "struct<address:string,topics:array<string>,data:string,logIndex:string,removed:boolean>"
_RECEIPT = f"struct<transactionHash:string,blockNumber:string,transactionIndex:string,status:string,from:string,to:string,gasUsed:string,effectiveGasPrice:string,l1Fee:string,logs:array<{_LOG}>>"
PAYLOAD = f"struct<chain:string,evm_layer:string,blockTimestamp:string,tx:{_TX},receipt:{_RECEIPT}>"


def payload_family(payload: Column, chain: Column) -> Column:
    """Which decoder a payload goes to."""
    has = lambda path: F.get_json_object(payload, path).isNotNull()
    return F.when(chain.isin("base", "ethereum") | has("$.tx") | has("$.receipt"), "evm").when((chain == "btc") | (has("$.txid") & (has("$.vin") | has("$.vout"))), "btc").otherwise("solana")


def split_unreadable(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable payloads, and the others as (chain, signature, error)."""
    bad = F.col("payload").isNull() | F.try_parse_json("payload").isNull()
    return payloads.where(~bad), payloads.where(bad).select("chain", "signature", F.when(F.col("payload").isNull(), "empty payload").otherwise("unreadable payload").alias("error"))


def lowered(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def topic_address(topic: Column) -> Column:
    """The last 40 digits of a topic; '' if it is shorter."""
    digits = F.regexp_replace(lowered(topic), "^0x", "")
    return F.when(F.length(digits) >= 40, F.concat(F.lit("0x"), F.right(digits, F.lit(40)))).otherwise("")


def address_topic(address: Column) -> Column:
    """S3: an address as a topic; '' unless it has 40 digits."""
    digits = F.regexp_replace(F.lower(F.trim(address)), "^0x", "")
    return F.when(F.length(digits) == 40, F.concat(F.lit("0x" + "0" * 24), digits)).otherwise("")


def matches_topics(topics: Column, wanted: list[str | None]) -> Column:
    """By position, whatever the case; None is any topic."""
    out = F.size(topics) >= len(wanted)
    for i, w in enumerate(wanted):
        if w is not None:
            out = out & (F.lower(F.get(topics, i)) == w.lower())
    return F.coalesce(out, F.lit(False))


def index_order(tx_index: Column) -> list[Column]:
    """Unknown (negative) indices after all others, equal among themselves."""
    return [F.when(tx_index < 0, 1).otherwise(0), F.when(tx_index >= 0, tx_index)]


def after_cursor(block: Column, index: Column, cursor_block: Column, cursor_index: Column) -> Column:
    """Strictly after a position; in its own block an unknown index counts as after."""
    return (block > cursor_block) | ((block == cursor_block) & ((index < 0) | (cursor_index < 0) | (index > cursor_index)))


def receipt_logs(receipts: DataFrame, wanted: list[str | None]) -> DataFrame:
    """S5 and S6 over (block_number, tx_hash, tx_index, logs): matching logs; what a log doesn't say comes from its receipt."""
    rows = receipts.select("block_number", "tx_hash", "tx_index", F.posexplode("logs").alias("place", "log"))
    return rows.where(matches_topics(F.col("log.topics"), wanted)).select("block_number", "tx_hash", "tx_index", "place", "log")


def internal_frames(frames: DataFrame) -> DataFrame:
    """The call trees of S7 over (tx_hash, frame_id, parent_id, from, to, value): each frame with its depth, below the roots. Whether a call
    failed is not asked, as a scan is to find every transaction that may matter.

    Each round doubles the steps that a frame has gone up, over written tables, so there are as many rounds as the depth of the
    deepest call has binary digits, and no bound on rows or depth. A frame of a circle has no root and is left out.
    """
    now = written(frames.select("tx_hash", "frame_id", F.col("parent_id").alias("_up"), F.col("parent_id").isNotNull().cast("int").alias("depth"), "from", "to", "value"), "frames")
    left = None
    while True:
        open_ = now.where("_up is not null").count()
        if not open_ or open_ == left:  # what no longer changes goes round in a circle
            break
        left = open_
        above = now.select(F.col("tx_hash").alias("_tx"), F.col("frame_id").alias("_frame"), F.col("_up").alias("_next"), F.col("depth").alias("_more"))
        step = now.where("_up is not null").join(above, (F.col("tx_hash") == F.col("_tx")) & (F.col("_up") == F.col("_frame")))
        up = step.select("tx_hash", "frame_id", F.col("_next").alias("_up"), (F.col("depth") + F.col("_more")).alias("depth"), "from", "to", "value")
        before, now = now, written(now.where("_up is null").unionAll(up), "frames")
        dropped(before)
    return now.where("_up is null").select("tx_hash", "frame_id", "from", "to", "value", "depth")


def internal_transfers(frames: DataFrame, watched: DataFrame) -> DataFrame:
    """The frames of internal_frames() that move value from or to one of watched (address), each once a frame."""
    w = watched.select(F.lower(F.trim("address")).alias("_watched")).distinct()
    tree = internal_frames(frames).where("value <> 0")
    party = lambda c: F.lower(F.trim(F.col(c)))
    by_from = tree.join(w, party("from") == F.col("_watched"), "left").withColumn("_from", F.col("_watched").isNotNull()).drop("_watched")
    by_to = by_from.join(w, party("to") == F.col("_watched"), "left")
    return by_to.where(F.col("_from") | F.col("_watched").isNotNull()).drop("_from", "_watched")


def scan(txs: DataFrame, logs: DataFrame, watched: DataFrame) -> DataFrame:
    """S1 over txs (tx_hash, block_number, tx_index, block_time, from, to), logs (tx_hash, block_number, tx_index, topics) and
    watched (address): each transaction that touches a watched address by a party or an indexed log, once."""
    w = watched.select(F.lower(F.trim("address")).alias("_watched")).distinct()
    parties = txs.select("tx_hash", "block_number", "tx_index", "block_time", F.explode(F.array(F.lower(F.trim("from")), F.lower(F.trim("to")))).alias("_watched"))
    topics = logs.select("tx_hash", "block_number", "tx_index", F.lit(None).cast("timestamp").alias("block_time"), F.explode(F.transform(F.slice("topics", 2, 3), topic_address)).alias("_watched"))
    hits = parties.unionByName(topics).join(w, "_watched", "left_semi")
    known = F.when(F.col("tx_index") < 0, F.lit(2**31 - 1)).otherwise(F.col("tx_index"))
    first = hits.groupBy("tx_hash").agg(F.min(F.struct("block_number", known.alias("_order"), "tx_index")).alias("_at"), F.min("block_time").alias("block_time"))
    return first.select("tx_hash", F.col("_at.block_number").alias("block_number"), F.col("_at.tx_index").alias("tx_index"), "block_time").orderBy("block_number", *index_order(F.col("tx_index")), "tx_hash")


def address_signatures(candidates: DataFrame, cursor: tuple[int, int], limit: int) -> DataFrame:
    """The next signatures of an address after its cursor."""
    later = candidates.where(after_cursor(F.col("block_number"), F.col("tx_index"), F.lit(cursor[0]), F.lit(cursor[1])))
    return later.orderBy("block_number", *index_order(F.col("tx_index")), "tx_hash").limit(limit)


def fetched(signatures: DataFrame, payloads: DataFrame) -> DataFrame:
    """Payloads by hash, in the order of the request; unknown ones are null."""
    return signatures.join(payloads.select("tx_hash", "payload"), "tx_hash", "left")


def finalized_head(blocks: DataFrame, confirmations: int) -> DataFrame:
    """S20."""
    return blocks.groupBy("chain", "network").agg(F.max("block_number").alias("head")).withColumn("finalized", F.greatest(F.lit(0), F.col("head") - confirmations).cast("long"))


def block_hashes(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """S21."""
    return wanted.join(blocks.select("chain", "network", "block_number", "block_hash", "parent_hash"), ["chain", "network", "block_number"], "left")


def transactions(payloads: DataFrame) -> DataFrame:
    """D3 and D4 over (chain, signature, payload): hash, block, status, fee and fee metadata; a missing status counts as failed."""
    p = payloads.withColumn("p", F.from_json("payload", PAYLOAD))
    tx, rc = (lambda f: F.col(f"p.tx.{f}")), (lambda f: F.col(f"p.receipt.{f}"))
    some = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    gas, price, data = hex_to_decimal(rc("gasUsed")), hex_to_decimal(some(rc("effectiveGasPrice"), tx("gasPrice"))), hex_to_decimal(rc("l1Fee"))
    execution = (gas.cast("decimal(19,0)") * price.cast("decimal(19,0)")).cast("decimal(38,0)")
    index = some(rc("transactionIndex"), tx("transactionIndex"))
    l1 = F.coalesce(F.col("p.evm_layer") == "l1", F.lit(False))
    text = lambda c: c.cast("string")
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    entries = F.when(l1, F.array(entry("gas_used", text(gas)), entry("effective_gas_price", text(price)))).otherwise(
        F.array(entry("fee_execution_l2", text(execution)), entry("base_gas_used", text(gas)), entry("base_effective_gas_price", text(price)))
    )
    more = F.array_compact(F.array(F.when(~l1 & (data > 0), entry("fee_data_l1", text(data))), F.when(some(rc("transactionIndex")).isNotNull(), entry("event_path", F.concat(F.lit("tx:"), text(hex_to_decimal(rc("transactionIndex"))))))))
    return p.select(
        "chain", "signature", some(tx("hash"), rc("transactionHash"), F.col("signature")).alias("tx_hash"), hex_to_decimal(some(rc("blockNumber"), tx("blockNumber"))).cast("long").alias("block_cursor"),
        hex_to_decimal(F.col("p.blockTimestamp")).cast("long").alias("block_time"), F.when(index.isNull(), -1).otherwise(hex_to_decimal(index)).cast("int").alias("tx_index"), lowered(some(tx("from"), rc("from"))).alias("fee_payer"),
        F.when(hex_to_decimal(rc("status")) == 0, "FAILED").otherwise("SUCCESS").alias("status"), text((execution + data).cast("decimal(38,0)")).alias("fee_amount"), F.map_from_entries(F.concat(entries, more)).alias("metadata"),
        lowered(some(tx("from"), rc("from"))).alias("from"), lowered(some(tx("to"), rc("to"))).alias("to"), hex_to_decimal(tx("value")).alias("value"), F.coalesce(rc("logs"), F.array().cast(f"array<{_LOG}>")).alias("logs"),
    )


def balance_events(decoded: DataFrame, watched: DataFrame, transfer_topic: str = TRANSFER_TOPIC, zeros: bool = False) -> DataFrame:
    """The events of watched parties: native transfers, token transfers, mints and burns. Failed transactions have none. Logs of an
    amount of zero have events with `zeros` only; unreadable amounts have none."""
    ok = decoded.where("status = 'SUCCESS'")
    side = lambda address, other, delta, category, action: F.struct(address.alias("address"), other.alias("counterparty"), delta.cast("string").alias("delta"), F.lit(category).alias("category"), F.lit(action).alias("action"))
    base = ["chain", "tx_hash", "block_cursor", "tx_index"]
    v = F.col("value")
    native = ok.where("value > 0").select(
        *base, F.concat(F.lit("tx:"), F.greatest(F.lit(0), "tx_index").cast("string")).alias("event_path"), F.lit("ETH").alias("contract"), F.lit("NATIVE").alias("token_type"),
        F.explode(F.array(side(F.col("from"), F.col("to"), -v, "TRANSFER", "native_transfer"), side(F.col("to"), F.col("from"), v, "TRANSFER", "native_transfer"))).alias("e"),
    )
    logs = ok.select(*base, F.explode("logs").alias("log")).where(~F.coalesce(F.col("log.removed"), F.lit(False)) & (F.size("log.topics") >= 3) & (F.lower(F.get("log.topics", F.lit(0))) == transfer_topic.lower()))
    a, b, n = topic_address(F.get("log.topics", F.lit(1))), topic_address(F.get("log.topics", F.lit(2))), hex_to_decimal(F.col("log.data"))
    zero = F.coalesce(F.trim(F.lower("log.data")).rlike("^(0x)?0+$"), F.lit(False))
    moved = logs.select(*base, F.concat(F.lit("log:"), hex_to_decimal(F.col("log.logIndex")).cast("string")).alias("event_path"), lowered(F.col("log.address")).alias("contract"), F.lit("FUNGIBLE").alias("token_type"), a.alias("a"), b.alias("b"), n.alias("n"), zero.alias("zero")).where((F.col("n") > 0) | (F.col("zero") & F.lit(zeros)))
    kinds = F.when(F.col("a") == ZERO_ADDRESS, F.array(side(F.col("b"), F.col("a"), F.col("n"), "MINT", "erc20_mint"))).when(F.col("b") == ZERO_ADDRESS, F.array(side(F.col("a"), F.col("b"), -F.col("n"), "BURN", "erc20_burn"))).otherwise(
        F.array(side(F.col("a"), F.col("b"), -F.col("n"), "TRANSFER", "erc20_transfer"), side(F.col("b"), F.col("a"), F.col("n"), "TRANSFER", "erc20_transfer"))
    )
    tokens = moved.select(*base, "event_path", "contract", "token_type", F.explode(kinds).alias("e"))
    w = watched.select(F.lower("address").alias("address")).where("address <> ''").distinct()
    return native.unionByName(tokens).select(*base, "event_path", "contract", "token_type", "e.*").join(w, "address", "left_semi")


def newest_payloads(payloads: DataFrame) -> DataFrame:
    """Of several payloads of one signature, the one that was fetched last."""
    return pick_winner(payloads, ["chain", "signature"], [F.col("fetched_at").desc()])
