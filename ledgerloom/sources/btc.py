"""UTXO chain: block scan, prevouts, envelopes and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.dedup import pick_winner

_VIN = "struct<index:int,txid:string,vout:int,address:string,value_sat:string,coinbase:boolean>"
_VOUT = "struct<index:int,address:string,value_sat:string>"
ENVELOPE = f"struct<chain:string,txid:string,block_height:long,block_hash:string,block_time:long,confirmations:long,fee_sat:string,fee_payer:string,vin:array<{_VIN}>,vout:array<{_VOUT}>>"


def satoshi(value: Column) -> Column:
    """A decimal coin amount as whole satoshi; null if it has more than eight places or is no number."""
    v = F.when(F.trim(value).rlike(r"^[+-]?[0-9]{1,11}(\.[0-9]{1,18})?$"), F.trim(value).try_cast("decimal(38,18)"))
    scaled = (v * F.lit(100_000_000)).cast("decimal(38,10)")
    return F.when(scaled == F.floor(scaled), scaled.cast("long"))


def output_addresses(address: Column, addresses: Column) -> Column:
    """The addresses of an output, each once, in order."""
    every = F.transform(F.concat(F.array(address), F.coalesce(addresses, F.array().cast("array<string>"))), lambda a: F.trim(a))
    return F.array_distinct(F.filter(every, lambda a: a.isNotNull() & (a != "")))


def resolved_inputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """S11 over inputs (txid, index, prev_txid, prev_vout, address, value_sat, coinbase) and outputs (txid, n, address, value_sat): an
    input's own prevout, else the output that it spends; unreadable values are 0."""
    spent = outputs.select(F.col("txid").alias("prev_txid"), F.col("n").alias("prev_vout"), F.col("address").alias("_address"), F.col("value_sat").alias("_value"))
    both = inputs.join(spent, ["prev_txid", "prev_vout"], "left")
    address = F.coalesce(F.nullif(F.trim("address"), F.lit("")), F.nullif(F.trim("_address"), F.lit("")))
    return both.select("txid", "index", "prev_txid", "prev_vout", "coinbase", address.alias("address"), F.coalesce(F.col("value_sat").try_cast("long"), F.col("_value").try_cast("long"), F.lit(0)).alias("value_sat"), (address.isNotNull() | F.col("_value").isNotNull()).alias("found"))


def scan(txs: DataFrame, inputs: DataFrame, outputs: DataFrame, watched: DataFrame) -> DataFrame:
    """Transactions (txid, block_height, tx_index) with a watched address among outputs or resolved inputs, once each."""
    w = watched.select(F.trim("address").alias("address")).distinct()
    sides = resolved_inputs(inputs.where("not coalesce(coinbase, false)"), outputs).select("txid", "address").unionByName(outputs.select("txid", F.trim("address").alias("address")))
    hits = sides.join(w, "address", "left_semi").select("txid").distinct()
    return pick_winner(txs.join(hits, "txid", "left_semi"), ["txid"], [F.col("block_height"), F.col("tx_index")]).orderBy("block_height", "tx_index", "txid")


def envelopes(txs: DataFrame, resolved: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per transaction its sorted outputs, the fee (inputs less outputs, if there are inputs and they suffice) and its payer (the
    least input address)."""
    ins = resolved.where("not coalesce(coinbase, false)").groupBy("txid").agg(F.sum("value_sat").alias("total_in"), F.min(F.nullif(F.col("address"), F.lit(""))).alias("fee_payer"))
    outs = outputs.groupBy("txid").agg(F.sum("value_sat").alias("total_out"), F.sort_array(F.collect_list(F.struct(F.col("n").alias("index"), "address", "value_sat"))).alias("vout"))
    both = txs.join(ins, "txid", "left").join(outs, "txid", "left")
    fee = F.when((F.col("total_in") > 0) & (F.col("total_in") >= F.coalesce("total_out", F.lit(0))), F.col("total_in") - F.coalesce("total_out", F.lit(0))).otherwise(0)
    return both.select(*txs.columns, fee.cast("string").alias("fee_sat"), "fee_payer", "vout")


def balance_events(payloads: DataFrame, watched: DataFrame) -> DataFrame:
    """D9 over (signature, payload): watched spends and receipts."""
    p = payloads.select("signature", F.from_json("payload", ENVELOPE).alias("p"))
    state = F.when(F.col("p.confirmations") > 0, "confirmed").otherwise("processed")
    base = [F.coalesce(F.nullif(F.trim("p.txid"), F.lit("")), F.trim("signature")).alias("tx_hash"), F.col("p.block_height").alias("block_cursor"), state.alias("finality_state")]

    def side(name: str, sign: str, action: str) -> DataFrame:
        rows = p.select(*base, F.explode(f"p.{name}").alias("x"))
        if name == "vin":
            rows = rows.where("x is not null and not coalesce(x.coinbase, false)")
        index = F.coalesce("x.index", F.lit(-1))
        value = F.when(F.trim("x.value_sat").rlike("^[0-9]{1,18}$"), F.trim("x.value_sat").try_cast("long"))
        path = F.concat(F.lit(f"{name}:"), F.greatest(F.lit(0), index).cast("string"))
        return rows.where(value > 0).select("tx_hash", "block_cursor", "finality_state", index.alias("outer_index"), F.trim("x.address").alias("address"), F.concat(F.lit(sign), value.cast("string")).alias("delta"), F.lit(action).alias("action"), path.alias("event_path"))

    w = watched.select(F.trim("address").alias("address")).where("address <> ''").distinct()
    return side("vin", "-", "vin_spend").unionByName(side("vout", "", "vout_receive")).join(w, "address", "left_semi")


def results(payloads: DataFrame) -> DataFrame:
    """Hash, fee and payer of each payload; a missing fee is inputs less outputs, a missing payer the least input address."""
    p = payloads.select("signature", F.from_json("payload", ENVELOPE).alias("p"))
    number = lambda c: F.coalesce(F.when(F.trim(c).rlike("^[0-9]{1,18}$"), F.trim(c).try_cast("long")), F.lit(0))
    real = F.filter(F.coalesce("p.vin", F.array().cast(f"array<{_VIN}>")), lambda v: ~F.coalesce(v["coinbase"], F.lit(False)))
    total = lambda xs: F.aggregate(F.transform(xs, lambda v: number(v["value_sat"])), F.lit(0).cast("long"), lambda a, x: a + x)
    total_in, total_out = total(real), total(F.coalesce("p.vout", F.array().cast(f"array<{_VOUT}>")))
    fee = F.when(number(F.col("p.fee_sat")) > 0, number(F.col("p.fee_sat"))).when((total_in > 0) & (total_in >= total_out), total_in - total_out).otherwise(0)
    payer = F.coalesce(F.nullif(F.trim("p.fee_payer"), F.lit("")), F.array_min(F.filter(F.transform(real, lambda v: F.trim(v["address"])), lambda a: a != "")), F.lit(""))
    return p.select(F.coalesce(F.nullif(F.trim("p.txid"), F.lit("")), F.trim("signature")).alias("tx_hash"), F.col("p.block_height").alias("block_cursor"), fee.cast("string").alias("fee_amount"), payer.alias("fee_payer"))
