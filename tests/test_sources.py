"""Decoding of raw payloads per family, and block scans."""

import json

from pyspark.sql import functions as F

from ledgerloom.sources import btc, evm, solana

A, B, C = "0x" + "a" * 40, "0x" + "b" * 40, "0x" + "c" * 40


def topic(address):
    return "0x" + "0" * 24 + address[2:]


def evm_payload(status="0x1", value="0x64", logs=(), **more):
    tx = {"hash": "0x1", "blockNumber": "0x10", "transactionIndex": "0x2", "from": A.upper().replace("0X", "0x"), "to": B, "value": value, "gasPrice": "0x3"}
    return json.dumps({"chain": "base", "blockTimestamp": "0x64", "tx": tx, "receipt": {"status": status, "gasUsed": "0x5208", "effectiveGasPrice": "0x2", "transactionIndex": "0x2", "logs": list(logs)} | more})


def frame(spark, *payloads):
    return spark.createDataFrame([("base", f"s{i}", p) for i, p in enumerate(payloads)], "chain string, signature string, payload string")


def watched(spark, *addresses):
    return spark.createDataFrame([(a,) for a in addresses], "address string")


def test_evm_native_transfer_and_fee(spark):
    d = evm.transactions(frame(spark, evm_payload(l1Fee="0x7")))
    r = d.first()
    assert (r.tx_hash, r.block_cursor, r.tx_index, r.status, r.fee_amount, r.fee_payer) == ("0x1", 16, 2, "SUCCESS", str(21000 * 2 + 7), A)
    assert r.metadata == {"fee_execution_l2": "42000", "base_gas_used": "21000", "base_effective_gas_price": "2", "fee_data_l1": "7", "event_path": "tx:2"}
    got = {(e.address, e.delta, e.event_path) for e in evm.balance_events(d, watched(spark, A, B)).collect()}
    assert got == {(A, "-100", "tx:2"), (B, "100", "tx:2")}


def test_evm_failed_and_missing_status(spark):
    d = evm.transactions(frame(spark, evm_payload(status="0x0"), evm_payload(status=None)))
    assert [r.status for r in d.collect()] == ["FAILED", "FAILED"]
    assert evm.balance_events(d, watched(spark, A, B)).count() == 0


def test_evm_tokens(spark):
    def log(a, b, n, i, **more):
        return {"address": C, "topics": [evm.TRANSFER_TOPIC, topic(a), topic(b)], "data": hex(n), "logIndex": hex(i)} | more

    logs = [log(A, B, 5, 1), log(evm.ZERO_ADDRESS, B, 6, 2), log(A, evm.ZERO_ADDRESS, 7, 3), log(A, B, 8, 4, removed=True), log(A, B, 0, 5), {"address": C, "topics": ["0x00"], "data": "0x1"}]
    got = {(e.address, e.delta, e.category, e.event_path, e.contract) for e in evm.balance_events(evm.transactions(frame(spark, evm_payload(value="0x0", logs=logs))), watched(spark, A, B)).collect()}
    assert got == {(A, "-5", "TRANSFER", "log:1", C), (B, "5", "TRANSFER", "log:1", C), (B, "6", "MINT", "log:2", C), (A, "-7", "BURN", "log:3", C)}


def test_router_and_unreadable(spark):
    df = spark.createDataFrame([("polygon", '{"tx": {}}'), ("btc", "{}"), ("solana", '{"slot": 1}'), ("x", '{"txid": "a", "vin": []}')], "chain string, payload string")
    assert [r.f for r in df.select(evm.payload_family(F.col("payload"), F.col("chain")).alias("f")).collect()] == ["evm", "btc", "solana", "btc"]
    good, bad = evm.split_unreadable(spark.createDataFrame([("b", "1", "{}"), ("b", "2", None), ("b", "3", "{oops")], "chain string, signature string, payload string"))
    assert good.count() == 1 and {r.error for r in bad.collect()} == {"empty payload", "unreadable payload"}


def test_evm_scan(spark):
    txs = spark.createDataFrame([("h1", 5, -1, None, A, B), ("h2", 5, 3, None, B, C), ("h1", 5, 2, None, A, B), ("h3", 4, 0, None, C, C)], "tx_hash string, block_number long, tx_index int, block_time timestamp, from string, to string")
    logs = spark.createDataFrame([("h3", 4, 0, ["0xt", topic(B), topic(C)])], "tx_hash string, block_number long, tx_index int, topics array<string>")
    assert [(r.tx_hash, r.tx_index) for r in evm.scan(txs, logs, watched(spark, B.upper().replace("0X", "0x"))).collect()] == [("h3", 0), ("h1", 2), ("h2", 3)]


def test_call_tree(spark):
    frames = spark.createDataFrame([("t", 1, None, "a", "b", 0, False), ("t", 2, 1, "a", "b", 5, False), ("t", 3, 1, "a", "b", 6, True), ("t", 4, 3, "a", "b", 7, False)], "tx_hash string, frame_id int, parent_id int, from string, to string, value long, failed boolean")
    assert {(r.frame_id, r.depth) for r in evm.internal_frames(frames).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}  # failed or not


def test_deep_call_tree_and_watched_parties(spark):
    kind = "tx_hash string, frame_id int, parent_id int, from string, to string, value long, failed boolean"
    deep = spark.range(1, 301).selectExpr("'t' as tx_hash", "cast(id as int) as frame_id", "cast(nullif(id - 1, 0) as int) as parent_id", "'a' as `from`", "'b' as `to`", "id as value", "false as failed")
    circle = spark.createDataFrame([("u", 1, 2, "a", "b", 5, False), ("u", 2, 1, "a", "b", 5, False), ("u", 3, 9, "a", "b", 5, False)], kind)
    assert {(r.tx_hash, r.frame_id, r.depth) for r in evm.internal_frames(deep.unionAll(circle)).collect()} == {("t", i, i - 1) for i in range(1, 301)}
    rows = [("t", 1, None, "x", "y", 9, False), ("t", 2, 1, " A ", "y", 5, False), ("t", 3, 2, "y", "a", 6, False), ("t", 4, 3, "a", "y", 0, False), ("t", 5, 3, "a", "A", 1, False)]
    got = evm.internal_transfers(spark.createDataFrame(rows, kind), watched(spark, "a")).collect()
    assert sorted((r.frame_id, r.depth) for r in got) == [(2, 1), (3, 2), (5, 3)]


def test_btc(spark):
    p = {"txid": "t", "block_height": 7, "confirmations": 1, "vin": [{"index": 0, "address": "x", "value_sat": "100"}, {"index": 1, "address": "w", "value_sat": "50", "coinbase": True}], "vout": [{"index": 0, "address": "y", "value_sat": "60"}, {"index": 1, "address": "x", "value_sat": "30"}]}
    df = spark.createDataFrame([("t", json.dumps(p))], "signature string, payload string")
    got = {(e.address, e.delta, e.event_path, e.finality_state) for e in btc.balance_events(df, watched(spark, "x", "w")).collect()}
    assert got == {("x", "-100", "vin:0", "confirmed"), ("x", "30", "vout:1", "confirmed")}
    r = btc.results(df).first()
    assert (r.fee_amount, r.fee_payer) == ("10", "x")


def test_satoshi_and_addresses(spark):
    df = spark.createDataFrame([("1.5", 150000000), ("0.00000001", 1), ("0.000000001", None), ("x", None), ("21000000", 2100000000000000)], "v string, want long")
    assert all(r.got == r.want for r in df.select("want", btc.satoshi(F.col("v")).alias("got")).collect())
    df = spark.createDataFrame([("a", ["b", "a", " "]), (None, None)], "a string, b array<string>")
    assert [r.x for r in df.select(btc.output_addresses(F.col("a"), F.col("b")).alias("x")).collect()] == [["a", "b"], []]


def solana_payload(instructions, inner=(), pre=(), post=(), err=None):
    return json.dumps({"slot": 9, "transaction": {"message": {"accountKeys": ["payer", "ta", "tb", {"pubkey": "k3"}], "instructions": instructions}}, "meta": {"err": err, "fee": 5000, "innerInstructions": list(inner), "preTokenBalances": list(pre), "postTokenBalances": list(post)}})


def test_solana_system_and_fee(spark):
    ix = [{"programId": solana.SYSTEM, "parsed": {"type": "transfer", "info": {"source": "payer", "destination": "3", "lamports": 42}}}]
    df = spark.createDataFrame([("s", solana_payload(ix)), ("f", solana_payload(ix, err={"x": 1}))], "signature string, payload string")
    got = {(e.signature, e.address, e.delta, e.category, e.outer_index) for e in solana.balance_events(df, watched(spark, "payer", "k3")).collect()}
    assert got == {("s", "payer", "-42", "TRANSFER", 0), ("s", "k3", "42", "TRANSFER", 0), ("s", "payer", "-5000", "FEE", -1)}


def test_solana_tokens_inner_and_signals(spark):
    token = lambda info, kind="transfer": {"programId": solana.TOKEN, "parsed": {"type": kind, "info": info}}
    outer = [{"programId": "other"}, token({"source": "ta", "destination": "tb", "amount": "7", "authority": "z"})]
    inner = [{"index": 0, "instructions": [token({"account": "tb", "mint": "m", "amount": "3"}, "mintTo")]}, {"index": 1, "instructions": [token({"source": "ta", "destination": "tb", "amount": "9"})]}]
    pre = [{"accountIndex": 1, "owner": "oa", "mint": "m", "uiTokenAmount": {"amount": "0"}}, {"accountIndex": 2, "owner": "ob", "mint": "m", "uiTokenAmount": {"amount": "1"}}]
    df = spark.createDataFrame([("s", solana_payload(outer, inner, pre))], "signature string, payload string")
    got = {(e.address, e.delta, e.outer_index, e.inner_index, e.signal) for e in solana.balance_events(df, watched(spark, "oa", "ob")).collect()}
    assert got == {("ob", "3", 0, 0, "phantom_deposit"), ("oa", "-7", 1, -1, "zero_balance_withdrawal"), ("ob", "7", 1, -1, "phantom_deposit")}
    scan = solana.scan(df.withColumns({"slot": F.lit(9), "ordinal": F.lit(0)}), watched(spark, "ob"))
    assert scan.count() == 1
