"""The ledger's queries over the driver's tables, each with SQL that DuckDB runs over the same views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import bignum
from ledgerloom.functions import scalar as S
from ledgerloom.operators import canonical, control, finality, ingest, metrics, serving, verify
from ledgerloom.operators.dedup import pick_winner
from ledgerloom.plans.views import duckdb_sql, view
from ledgerloom.sources import btc, evm, solana

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FORK, HEAD = 1500, 2000


def query(views: str = "", sql: str = "") -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = duckdb_sql(views.split(), sql)
        return f

    return put


def long(c: Column | str, name: str) -> Column:
    return S.col(c).cast("long").alias(name)


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Events with a total order."""
    return view(spark, d, "v_event").withColumn("ordinal", F.struct("block_cursor", "event_id")).withColumn("balance_applied", F.col("applied"))


def raw(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_event_raw").withColumn("ordinal", F.struct("created_at", "delta_n", "contract", "counterparty"))


def liquid(spark: SparkSession, d: str) -> DataFrame:
    """Balances that the applied events make."""
    return ingest.adjustments(ledger(spark, d).where("applied"))


# balances -----------------------------------------------------------------------------------------------------------


@query("v_event", "SELECT chain, address, CAST(sum(delta_n) AS BIGINT) AS balance, max(block_cursor) AS last_cursor, count(*) AS n_events FROM v_event WHERE applied GROUP BY chain, address")
def balance_by_address(spark, d):
    return ledger(spark, d).where("applied").groupBy("chain", "address").agg(long(F.sum("delta_n"), "balance"), F.max("block_cursor").alias("last_cursor"), F.count("*").alias("n_events"))


@query("v_event", """SELECT chain, network, address, contract, balance_type, CAST(sum(change) AS BIGINT) AS amount, max(block_cursor) AS last_updated_cursor FROM (
    SELECT *, '' AS balance_type, delta_n AS change FROM v_event WHERE applied UNION ALL SELECT *, 'staked', -delta_n FROM v_event WHERE applied AND category = 'STAKE') x GROUP BY ALL""")  # fmt: skip
def staked_mirror(spark, d):
    return liquid(spark, d).select(*ingest.BALANCE_KEY, long("amount", "amount"), "last_updated_cursor")


@query("v_event", """SELECT event_id, CASE WHEN applied THEN CAST(s - delta_n AS BIGINT) END AS balance_before, CASE WHEN applied THEN CAST(s AS BIGINT) END AS balance_after FROM (
    SELECT *, sum(CASE WHEN applied THEN delta_n ELSE 0 END) OVER (PARTITION BY chain, network, address, contract ORDER BY block_cursor, event_id) AS s FROM v_event) x""")  # fmt: skip
def running_balance(spark, d):
    return ingest.running_balances(ledger(spark, d)).select("event_id", long("balance_before", "balance_before"), long("balance_after", "balance_after"))


@query("v_event", """WITH old AS (SELECT address, contract, CAST(sum(delta_n) AS BIGINT) AS amount, max(block_cursor) AS c FROM v_event WHERE applied AND category <> 'STAKE' AND block_cursor < 1500 GROUP BY ALL),
    new AS (SELECT address, contract, CAST(sum(delta_n) AS BIGINT) AS amount, max(block_cursor) AS c FROM v_event WHERE applied AND category <> 'STAKE' AND block_cursor >= 1500 GROUP BY ALL)
    SELECT coalesce(o.address, n.address) AS address, coalesce(o.contract, n.contract) AS contract, coalesce(o.amount, 0) + coalesce(n.amount, 0) AS amount, greatest(coalesce(o.c, n.c), coalesce(n.c, o.c)) AS last_updated_cursor
    FROM old o FULL JOIN new n ON o.address = n.address AND o.contract = n.contract""")  # fmt: skip
def balance_adjust(spark, d):
    own = ledger(spark, d).where("applied and category <> 'STAKE'")
    return ingest.adjusted(ingest.adjustments(own.where(f"block_cursor < {FORK}")), ingest.adjustments(own.where(f"block_cursor >= {FORK}"))).select("address", "contract", long("amount", "amount"), "last_updated_cursor")


@query("v_event", """WITH b AS (SELECT chain, network, address, contract, sum(delta_n) AS amount FROM v_event WHERE applied GROUP BY ALL), k AS (SELECT DISTINCT chain, network, address, contract FROM v_event)
    SELECT k.*, CAST(coalesce(b.amount, 0) AS BIGINT) AS amount, b.amount IS NOT NULL AS is_there FROM k LEFT JOIN b USING (chain, network, address, contract)""")  # fmt: skip
def balance_prefetch(spark, d):
    keys = ledger(spark, d).select("chain", "network", "address", "contract").distinct().withColumn("balance_type", F.lit(""))
    return ingest.prefetched(keys, liquid(spark, d)).select("chain", "network", "address", "contract", long("amount", "amount"), "is_there")


# duplicates and ingestion ---------------------------------------------------------------------------------------------


@query("v_event", "SELECT event_id, finality_state, contract, counterparty, delta FROM v_event")
def event_dedup(spark, d):
    return canonical_events(spark, d).select("event_id", "finality_state", "contract", "counterparty", "delta")


def canonical_events(spark, d):
    """One event per id by the ledger's order: finality, then action, contract, counterparty and amount."""
    return canonical.account_winners(view(spark, d, "v_event_raw").withColumn("ordinal", F.col("created_at")))


@query("v_tx", "SELECT chain, network, lower(tx_hash) AS identity, min(ordinal) AS ordinal FROM (SELECT *, CASE WHEN chain IN ('solana') THEN tx_hash ELSE tx_hash END AS h FROM v_tx) x WHERE chain <> 'solana' AND chain <> 'btc' GROUP BY ALL")
def tx_dedup(spark, d):
    tx = view(spark, d, "v_tx").where("chain not in ('solana', 'btc')")
    return ingest.first_transactions(tx).select("chain", "network", "identity", "ordinal")


@query("v_event", "SELECT chain, network, contract, min(struct_pack(a := block_cursor, b := event_id)).b AS event_id FROM v_event GROUP BY ALL")
def token_first_seen(spark, d):
    return ingest.first_tokens(ledger(spark, d)).select("chain", "network", "contract", "event_id")


@query("v_tx v_event_raw", """SELECT tx_hash, concat('fee:', chain, ':', tx_hash) AS event_id, fee_payer AS address, concat('-', fee_amount) AS delta FROM v_tx
    WHERE status = 'FAILED' AND CAST(fee_amount AS BIGINT) > 0 AND tx_hash NOT IN (SELECT tx_hash FROM v_event_raw)""")  # fmt: skip
def failed_tx_fee(spark, d):
    return ingest.failed_fees(view(spark, d, "v_tx"), view(spark, d, "v_event_raw")).select("tx_hash", "event_id", "address", "delta")


def tokens_by_chain(spark, d):
    return view(spark, d, "v_token").crossJoin(F.broadcast(view(spark, d, "v_chain").select("chain", "network")))


@query("v_event v_token", "SELECT e.chain, count(*) AS n, CAST(sum(e.delta_n) AS BIGINT) AS total FROM v_event e JOIN v_token t ON e.contract = t.contract WHERE NOT t.is_denied GROUP BY e.chain")
def denied_filter(spark, d):
    return ingest.without_denied(ledger(spark, d), tokens_by_chain(spark, d)).groupBy("chain").agg(F.count("*").alias("n"), long(F.sum("delta_n"), "total"))


@query("v_event", """WITH p AS (SELECT *, coalesce(bool_or(applied) OVER (PARTITION BY chain, network, address, contract ORDER BY block_cursor, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS before FROM v_event),
    f AS (SELECT chain, network, contract, min(struct_pack(a := block_cursor, b := event_id)) AS first FROM p WHERE token_type <> 'NATIVE' AND chain <> 'btc' AND delta_n < 0 AND NOT before GROUP BY ALL)
    SELECT p.event_id, coalesce(struct_pack(a := p.block_cursor, b := p.event_id) >= f.first, FALSE) AS skipped FROM p LEFT JOIN f USING (chain, network, contract)""")  # fmt: skip
def scam_first_fire(spark, d):
    events = ledger(spark, d).withColumn("signal", F.lit(""))
    none = events.select("chain", "network", "address", "contract").limit(0)
    return ingest.scam_denials(events, none).select("event_id", "skipped")


@query("v_event v_watched", """WITH w AS (SELECT chain, network, address, wallet_id, organization_id FROM v_watched WHERE is_active UNION ALL SELECT DISTINCT chain, network, concat('sup', CAST(k AS STRING)), 'w', 'o' FROM v_chain, (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) n)
    SELECT e.event_id, coalesce(a.address, b.address) AS watched_address, CASE WHEN a.address IS NOT NULL THEN a.wallet_id ELSE b.wallet_id END AS wallet_id, CASE WHEN a.address IS NOT NULL THEN a.organization_id ELSE b.organization_id END AS organization_id
    FROM v_event e LEFT JOIN w a ON e.chain = a.chain AND e.network = a.network AND e.address = a.address LEFT JOIN w b ON e.chain = b.chain AND e.network = b.network AND e.counterparty = b.address""")  # fmt: skip
def watched_resolution(spark, d):
    """Watched are the active addresses and three counterparties."""
    own = view(spark, d, "v_watched").where("is_active").select("chain", "network", "address", "wallet_id", "organization_id")
    others = view(spark, d, "v_chain").select("chain", "network", F.explode(F.array(*[F.lit(f"sup{k}") for k in (1, 2, 3)])).alias("address"), F.lit("w").alias("wallet_id"), F.lit("o").alias("organization_id"))
    return ingest.resolved_watch(ledger(spark, d), own.unionByName(others)).select("event_id", "watched_address", "wallet_id", "organization_id")


def two_batches(spark, d):
    """An older ledger and a later batch of the same events, one row per id each."""
    rows = raw(spark, d).withColumn("balance_applied", F.col("finality_state") != "pending").withColumn("tx_index", F.col("outer_index"))
    one = lambda when: pick_winner(rows.where(when), ["event_id"], [F.col("created_at"), F.col("delta_n"), F.col("contract"), F.col("counterparty")]).select("event_id", "chain", "finality_state", "balance_applied", "tx_index", "block_cursor", "delta_n")
    return one("action <> 'A' or outer_index > 2"), one("action <> 'R' and outer_index <= 4")


_BATCHES = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at, delta_n, contract, counterparty) AS k1 FROM v_event_raw WHERE action <> 'A' OR outer_index > 2),
    s AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at, delta_n, contract, counterparty) AS k1 FROM v_event_raw WHERE action <> 'R' AND outer_index <= 4),
    o AS (SELECT *, CASE finality_state WHEN 'pending' THEN 1 WHEN 'confirmed' THEN 2 ELSE 4 END AS k FROM r WHERE k1 = 1), n AS (SELECT *, CASE finality_state WHEN 'pending' THEN 1 WHEN 'confirmed' THEN 2 ELSE 4 END AS k FROM s WHERE k1 = 1)"""


@query("v_event_raw", _BATCHES + """ SELECT coalesce(o.event_id, n.event_id) AS event_id, CASE WHEN o.event_id IS NULL OR n.k >= o.k THEN n.finality_state ELSE o.finality_state END AS finality_state,
    CASE WHEN o.event_id IS NULL THEN n.finality_state <> 'pending' WHEN n.k >= o.k THEN o.finality_state <> 'pending' OR n.finality_state <> 'pending' ELSE o.finality_state <> 'pending' END AS balance_applied,
    coalesce(o.delta_n, n.delta_n) AS delta_n FROM o FULL JOIN n ON o.event_id = n.event_id""")  # fmt: skip
def event_upsert_finality(spark, d):
    return ingest.upserted_events(*two_batches(spark, d)).select("event_id", "finality_state", "balance_applied", "delta_n")


@query("v_event_raw", _BATCHES + """ SELECT n.chain, count(*) FILTER (WHERE o.event_id IS NULL) AS inserted, count(*) FILTER (WHERE n.k >= o.k) AS updated, count(*) FILTER (WHERE n.k < o.k) AS kept,
    count(*) FILTER (WHERE n.k >= o.k AND n.k > 1 AND o.k = 1) AS crossed FROM n LEFT JOIN o ON o.event_id = n.event_id GROUP BY n.chain""")  # fmt: skip
def upsert_outcomes(spark, d):
    return ingest.upsert_outcomes(*two_batches(spark, d))


@query("v_tx", "SELECT chain, network, max(block_cursor) AS ingested_sequence FROM v_tx WHERE status = 'FAILED' OR block_cursor < 1500 GROUP BY ALL")
def watermark_advance(spark, d):
    marks = view(spark, d, "v_tx").select("chain", "network", "status", F.col("block_cursor").alias("ingested_sequence"))
    old = marks.where(f"ingested_sequence < {FORK}").groupBy("chain", "network").agg(F.max("ingested_sequence").alias("ingested_sequence"))
    return ingest.watermarks(old, marks.where("status = 'FAILED'").select("chain", "network", "ingested_sequence"))


@query("v_block", "SELECT chain, network, block_number, block_hash, finality_state FROM v_block")
def indexed_blocks(spark, d):
    b = view(spark, d, "v_block").select("chain", "network", "block_number", "block_hash", "parent_hash", "finality_state")
    old = b.where("block_number % 2 = 0").withColumn("finality_state", F.lit("pending"))
    return ingest.indexed_blocks(old, b.withColumn("ordinal", F.col("block_number"))).select("chain", "network", "block_number", "block_hash", "finality_state")


@query("v_event", "SELECT event_id, chain = 'solana' OR finality_state <> 'pending' AS is_final, applied FROM v_event")
def apply_threshold(spark, d):
    e = ledger(spark, d)
    return e.select("event_id", ((F.col("chain") == "solana") | (S.rank_ingest("finality_state") >= 2)).alias("is_final"), ingest.applies(F.col("chain"), F.col("finality_state"), F.col("token_type"), F.col("delta")).alias("applied"))


@query("v_tx", "SELECT chain, tx_hash, n AS turn FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY ordinal) AS n FROM v_tx) x")
def commit_turns(spark, d):
    return ingest.interleaved(view(spark, d, "v_tx")).select("chain", "tx_hash", long("turn", "turn"))


# scalars ------------------------------------------------------------------------------------------------------------


@query("v_tx", "SELECT ordinal, CASE chain WHEN 'btc' THEN substr(lower(tx_hash), 3) WHEN 'solana' THEN tx_hash ELSE lower(tx_hash) END AS identity FROM v_tx")
def canonical_tx_hash(spark, d):
    return view(spark, d, "v_tx").select("ordinal", S.signature_identity("chain", "tx_hash").alias("identity"))


@query("v_tx", "SELECT ordinal, concat(' 0XAB', CAST(ordinal AS STRING), ' ') AS given, CASE WHEN chain IN ('btc', 'solana') THEN concat('0XAB', CAST(ordinal AS STRING)) ELSE concat('0xab', CAST(ordinal AS STRING)) END AS identity FROM v_tx")
def canonical_address(spark, d):
    t = view(spark, d, "v_tx").select("ordinal", "chain", F.concat(F.lit(" 0XAB"), F.col("ordinal").cast("string"), F.lit(" ")).alias("given"))
    return t.select("ordinal", "given", S.address_identity("chain", "given").alias("identity"))


@query("v_event_raw", "SELECT DISTINCT event_id FROM v_event_raw")
def event_id_hash(spark, d):
    e = view(spark, d, "v_event_raw")
    return e.select(S.event_id("chain", "network", "tx_hash", S.event_path("outer_index", "inner_index"), "address", F.lit(""), S.activity("category", "delta")).alias("event_id")).distinct()


@query("v_event", "SELECT activity, category, count(*) AS n FROM v_event GROUP BY ALL")
def classify_activity(spark, d):
    return ledger(spark, d).groupBy(S.activity("category", "delta").alias("activity"), "category").agg(F.count("*").alias("n"))


@query("v_event", """SELECT state, count(*) AS n, CASE state WHEN 'pending' THEN 1 WHEN 'confirmed' THEN 2 WHEN 'finalized' THEN 4 WHEN 'processed' THEN 1 ELSE 0 END AS rank_norm,
    CASE state WHEN 'pending' THEN 1 WHEN 'confirmed' THEN 2 WHEN 'finalized' THEN 4 WHEN 'processed' THEN 1 ELSE 4 END AS rank_ingest,
    CASE state WHEN 'pending' THEN 1 WHEN 'confirmed' THEN 2 WHEN 'finalized' THEN 4 ELSE 0 END AS rank_store
    FROM (SELECT CASE outer_index WHEN 1 THEN 'processed' WHEN 2 THEN '' ELSE finality_state END AS state FROM v_event) x GROUP BY state""")  # fmt: skip
def finality_ranks(spark, d):
    state = F.when(F.col("outer_index") == 1, "processed").when(F.col("outer_index") == 2, "").otherwise(F.col("finality_state"))
    return ledger(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n")).select("state", "n", S.rank_norm("state").alias("rank_norm"), S.rank_ingest("state").alias("rank_ingest"), S.rank_store("state").alias("rank_store"))


@query("v_tx", "SELECT ordinal, CASE ordinal % 4 WHEN 0 THEN concat('-', fee_amount) WHEN 1 THEN '-0' WHEN 2 THEN '-0' ELSE concat('-', fee_amount) END AS delta FROM v_tx")
def fee_delta(spark, d):
    given = F.expr("CASE ordinal % 4 WHEN 0 THEN concat('+', fee_amount) WHEN 1 THEN ' 0' WHEN 2 THEN concat(fee_amount, '.5') ELSE concat(' ', fee_amount) END")
    return view(spark, d, "v_tx").select("ordinal", S.fee_delta(given).alias("delta"))


@query("v_signal", "SELECT ordinal, json_extract_string(props, '$.k') AS k FROM v_signal")
def json_metadata(spark, d):
    return view(spark, d, "v_signal").select("ordinal", F.element_at(S.string_map("props"), "k").alias("k"))


@query("v_event", "SELECT chain, CAST(sum(delta_n) AS STRING) AS total FROM v_event GROUP BY chain")
def bignum_sum(spark, d):
    return bignum.big_sum(ledger(spark, d), ["chain"], "delta")


@query("v_event", "SELECT event_id, CAST(-delta_n AS STRING) AS negated FROM v_event")
def negate_delta(spark, d):
    return ledger(spark, d).select("event_id", S.negated("delta").alias("negated"))


@query("v_event", "SELECT event_id, outer_index, inner_index FROM v_event")
def path_parse(spark, d):
    p = S.path_indices("event_path")
    return ledger(spark, d).select("event_id", p["outer"].alias("outer_index"), p["inner"].alias("inner_index"))


# canonicalisation -----------------------------------------------------------------------------------------------------


@query("v_event", "SELECT chain, tx_hash, max(block_cursor) AS sequence FROM v_event WHERE chain <> 'solana' GROUP BY ALL")
def signature_dedup(spark, d):
    e = ledger(spark, d).where("chain <> 'solana'").select("chain", "tx_hash", F.col("block_cursor").alias("sequence"), "block_time")
    return canonical.fetched_signatures(e).select("chain", "tx_hash", "sequence")


@query("v_tx", """WITH t AS (SELECT chain, tx_hash, block_cursor AS sequence FROM v_tx WHERE block_cursor BETWEEN 1495 AND 1501 OR (chain = 'base' AND block_cursor BETWEEN 1502 AND 1510)),
    c AS (SELECT chain, count(*) FILTER (WHERE sequence > 1500) AS newer, max(sequence) AS top FROM t GROUP BY chain),
    n AS (SELECT chain, tx_hash, sequence FROM t WHERE sequence > 1500 QUALIFY row_number() OVER (PARTITION BY chain ORDER BY sequence, tx_hash) <= 5),
    h AS (SELECT chain, tx_hash, sequence, row_number() OVER (PARTITION BY chain ORDER BY tx_hash DESC) AS place FROM t WHERE sequence = 1500)
    SELECT * FROM n UNION ALL SELECT h.chain, h.tx_hash, h.sequence FROM h JOIN c USING (chain) WHERE h.place <= greatest(0, 5 - c.newer) UNION ALL SELECT t.* FROM t JOIN c USING (chain) WHERE c.top < 1500""")  # fmt: skip
def carryover_select(spark, d):
    t = view(spark, d, "v_tx").where("block_cursor between 1495 and 1501 or (chain = 'base' and block_cursor between 1502 and 1510)").select("chain", "tx_hash", F.col("block_cursor").alias("sequence"))
    return canonical.carried_over(t, FORK, 5)


@query("v_event", """SELECT event_id, CASE WHEN own THEN 'SELF_TRANSFER' ELSE activity END AS activity, CASE WHEN own THEN '0' ELSE delta END AS delta
    FROM (SELECT *, category = 'TRANSFER' AND chain <> 'btc' AND outer_index = 3 AS own FROM v_event) x""")  # fmt: skip
def self_transfer(spark, d):
    e = ledger(spark, d).withColumn("counterparty", F.when(F.col("outer_index") == 3, F.col("address")).otherwise(F.col("counterparty")))
    return canonical.self_transfers(e).select("event_id", "activity", "delta")


@query("v_tx", """WITH t AS (SELECT chain, tx_hash, CAST(fee_amount AS BIGINT) AS fee, ordinal, ordinal % 3 AS k FROM v_tx),
    l2 AS (SELECT *, CASE k WHEN 0 THEN NULL ELSE fee // 4 END AS data, CASE k WHEN 1 THEN fee - fee // 4 WHEN 2 THEN fee ELSE NULL END AS known FROM t WHERE chain = 'base')
    SELECT tx_hash, 'FEE' AS activity, concat('-', CAST(fee AS STRING)) AS delta, FALSE AS fee_total_mismatch, FALSE AS data_fee_l1_unavailable FROM t WHERE chain <> 'base' AND fee <> 0
    UNION ALL SELECT tx_hash, 'FEE_EXECUTION_L2', concat('-', CAST(coalesce(known, fee) AS STRING)), k = 2 AND data <> 0, k = 0 FROM l2 WHERE coalesce(known, fee) <> 0
    UNION ALL SELECT tx_hash, 'FEE_DATA_L1', concat('-', CAST(data AS STRING)), k = 2 AND data <> 0, FALSE FROM l2 WHERE data <> 0""")  # fmt: skip
def fee_split(spark, d):
    quarter = F.expr("cast(cast(fee_amount as bigint) div 4 as string)")
    rest = F.expr("cast(cast(fee_amount as bigint) - cast(fee_amount as bigint) div 4 as string)")
    k = F.col("ordinal") % 3
    m = F.when(k == 1, F.create_map(F.lit("fee_execution_l2"), rest, F.lit("fee_data_l1"), quarter)).when(k == 2, F.create_map(F.lit("fee_execution_l2"), F.col("fee_amount"), F.lit("l1_fee"), quarter)).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    return canonical.split_fees(view(spark, d, "v_tx").withColumn("metadata", m)).select("tx_hash", "activity", "delta", "fee_total_mismatch", "data_fee_l1_unavailable")


@query("v_event", """WITH x AS (SELECT *, outer_index // 2 AS o, CASE outer_index % 2 WHEN 0 THEN -1 ELSE 0 END AS i FROM v_event)
    SELECT x.event_id, CASE WHEN w.tx_hash IS NOT NULL THEN -1 ELSE x.i END AS inner_index FROM x LEFT JOIN (SELECT DISTINCT tx_hash, o, address, contract, activity FROM x WHERE i = -1) w
    ON x.tx_hash = w.tx_hash AND x.o = w.o AND x.address = w.address AND x.contract = w.contract AND x.activity = w.activity""")  # fmt: skip
def owner_suppression(spark, d):
    e = ledger(spark, d).select("event_id", "tx_hash", "address", F.col("contract").alias("asset"), "activity", F.floor(F.col("outer_index") / 2).cast("int").alias("outer"), F.when(F.col("outer_index") % 2 == 0, -1).otherwise(0).alias("inner"))
    return canonical.owned_by_outer(e).select("event_id", F.col("inner").cast("int").alias("inner_index"))


@query("v_event_raw", """SELECT tx_hash, event_path, address, contract, category, finality_state FROM (SELECT *, row_number() OVER (PARTITION BY tx_hash, event_path, address, contract, category
    ORDER BY finality_state = 'pending', finality_state, delta_n, created_at, counterparty) AS place FROM v_event_raw) x WHERE place = 1""")  # fmt: skip
def coverage_merge(spark, d):
    hinted = F.col("finality_state") != "pending"
    e = view(spark, d, "v_event_raw").withColumns({"path": F.col("event_path"), "asset": F.col("contract"), "path_hinted": hinted, "n_metadata": F.lit(0), "n_filled": F.lit(0), "fingerprint": F.struct("finality_state", "delta_n", "created_at", "counterparty"), "ordinal": F.lit(0)})
    return canonical.coverage(e).select("tx_hash", "event_path", "address", "contract", "category", "finality_state")


@query("v_event", """SELECT chain, tx_hash, CASE max(CASE finality_state WHEN 'finalized' THEN 4 WHEN 'confirmed' THEN 2 ELSE 1 END) WHEN 4 THEN 'finalized' WHEN 2 THEN 'confirmed' ELSE 'processed' END AS finality_state FROM v_event GROUP BY ALL""")
def result_finality(spark, d):
    return canonical.result_finality(ledger(spark, d).withColumn("metadata", F.create_map(F.lit("finality"), F.col("finality_state"))))


@query("v_tx", "SELECT chain, network, max(struct_pack(a := block_cursor, b := tx_hash)).a AS sequence, max(struct_pack(a := block_cursor, b := tx_hash)).b AS value FROM v_tx WHERE status = 'SUCCESS' GROUP BY ALL")
def cursor_advance(spark, d):
    return canonical.cursor_advance(view(spark, d, "v_tx").where("status = 'SUCCESS'").select("chain", "network", F.col("block_cursor").alias("sequence"), F.col("tx_hash").alias("value")))


@query("v_tx", "SELECT tx_hash AS identity, CASE WHEN status = 'FAILED' AND block_cursor < 1200 THEN 'missing' WHEN status = 'FAILED' THEN 'failed' ELSE 'ok' END AS outcome FROM v_tx")
def result_matching(spark, d):
    t = view(spark, d, "v_tx").select(F.col("tx_hash").alias("identity"), "block_cursor", F.when(F.col("status") == "FAILED", "x").alias("error"))
    return canonical.matched_results(t, t.where("error is null or block_cursor >= 1200"))


@query("v_event", "SELECT DISTINCT tx_hash AS identity, CASE WHEN bool_or(finality_state = 'pending') THEN 'transient' ELSE 'terminal' END AS class, CASE WHEN bool_or(finality_state = 'pending') THEN 'pending' ELSE min(finality_state) END AS reason FROM v_event GROUP BY tx_hash")
def decode_error_class(spark, d):
    e = ledger(spark, d).select(F.col("tx_hash").alias("identity"), F.when(F.col("finality_state") == "pending", "transient").otherwise("terminal").alias("class"), F.col("finality_state").alias("reason"))
    return canonical.decode_errors(e)


# finality, reorganisation, replay -----------------------------------------------------------------------------------


@query("v_event", "SELECT event_id, CASE WHEN block_cursor <= 2000 THEN 'finalized' ELSE finality_state END AS finality_state, block_cursor <= 2000 AND NOT applied AS newly_applied FROM v_event")
def promote_finality(spark, d):
    return finality.promoted_events(ledger(spark, d), F.lit(HEAD)).select("event_id", "finality_state", "newly_applied")


@query("v_event", """SELECT address, contract, balance_type, CAST(sum(c) AS BIGINT) AS amount FROM (SELECT address, contract, '' AS balance_type, delta_n AS c FROM v_event WHERE block_cursor <= 2000 AND NOT applied
    UNION ALL SELECT address, contract, 'staked', -delta_n FROM v_event WHERE block_cursor <= 2000 AND NOT applied AND category = 'STAKE') x GROUP BY ALL""")  # fmt: skip
def promotion_adjustments(spark, d):
    return finality.changes(finality.promoted_events(ledger(spark, d), F.lit(HEAD)).where("newly_applied")).select("address", "contract", "balance_type", long("amount", "amount"))


@query("v_block", "SELECT chain, block_number, CASE WHEN block_number <= 2000 THEN 'finalized' ELSE finality_state END AS finality_state FROM v_block")
def promote_blocks(spark, d):
    return finality.promoted_blocks(view(spark, d, "v_block"), F.lit(HEAD)).select("chain", "block_number", "finality_state")


@query("v_block", "SELECT chain, block_number FROM v_block WHERE finality_state <> 'finalized' ORDER BY block_number DESC, chain LIMIT 1000")
def unfinalized_top(spark, d):
    return finality.unfinalized(view(spark, d, "v_block")).select("chain", "block_number")


@query("v_block", """SELECT chain, network, min(b.block_number) AS fork_block, min(struct_pack(a := b.block_number, h := p.block_hash)).h AS expected_hash, min(struct_pack(a := b.block_number, h := b.block_hash)).h AS actual_hash
    FROM v_block b JOIN v_block p USING (chain, network) WHERE p.block_number = b.block_number - 1 AND b.parent_hash <> p.block_hash GROUP BY chain, network""")  # fmt: skip
def parent_hash_break(spark, d):
    return finality.parent_breaks(view(spark, d, "v_block"))


@query("v_block", "SELECT chain, network, min(block_number) AS fork_block FROM v_block WHERE block_number % 89 = 0 AND block_number % 2 = 1 GROUP BY ALL")
def chain_hash_mismatch(spark, d):
    b = view(spark, d, "v_block")
    real = b.withColumn("block_hash", F.when(F.col("block_number") % 89 == 0, F.lit("other")).otherwise(F.col("block_hash")))
    return finality.hash_mismatches(b, real, b.where("block_number % 2 = 0")).select("chain", "network", "fork_block")


@query("v_event", """SELECT address, contract, balance_type, CAST(sum(c) AS BIGINT) AS amount FROM (SELECT address, contract, '' AS balance_type, -delta_n AS c FROM v_event WHERE block_cursor >= 1500 AND applied
    UNION ALL SELECT address, contract, 'staked', delta_n FROM v_event WHERE block_cursor >= 1500 AND applied AND category = 'STAKE') x GROUP BY ALL""")  # fmt: skip
def reorg_reversal(spark, d):
    return finality.reversals(ledger(spark, d), F.lit(FORK)).select("address", "contract", "balance_type", long("amount", "amount"))


@query("v_event", "SELECT chain, count(*) AS n, max(block_cursor) AS last FROM v_event WHERE block_cursor < 1500 GROUP BY chain")
def rollback_ledger(spark, d):
    return finality.rolled_back(ledger(spark, d), F.lit(FORK)).groupBy("chain").agg(F.count("*").alias("n"), F.max("block_cursor").alias("last"))


@query("v_event v_tx v_block", """SELECT chain, network, e AS events, t AS transactions, b AS blocks, r AS reversed, f > 0 AS refused FROM
    (SELECT chain, network, count(*) AS e, count(*) FILTER (WHERE applied) AS r, count(*) FILTER (WHERE finality_state = 'finalized') AS f FROM v_event WHERE block_cursor >= 1500 GROUP BY ALL) x
    JOIN (SELECT chain, network, count(*) AS t FROM v_tx WHERE block_cursor >= 1500 GROUP BY ALL) y USING (chain, network) JOIN (SELECT chain, network, count(*) AS b FROM v_block WHERE block_number >= 1500 GROUP BY ALL) z USING (chain, network)""")  # fmt: skip
def purge_dry_run(spark, d):
    return finality.purge_counts(ledger(spark, d), view(spark, d, "v_tx"), view(spark, d, "v_block"), FORK)


@query("v_event", "SELECT event_id, chain FROM v_event WHERE event_id > '8' ORDER BY event_id LIMIT 1000")
def keyset_page(spark, d):
    return finality.keyset_page(ledger(spark, d), "event_id", "8").select("event_id", "chain")


@query("v_watched", "SELECT chain, network, min(backfill_from_block) AS from_block, count(*) AS addresses FROM v_watched WHERE is_active AND backfill_from_block IS NOT NULL GROUP BY ALL HAVING min(backfill_from_block) < 1000")
def backfill_pending(spark, d):
    starts = view(spark, d, "v_chain").select("chain", "network", F.lit(1000).alias("start_block"))
    return finality.backfills(view(spark, d, "v_watched"), F.broadcast(starts))


@query("v_tx", "SELECT chain, network, max(block_cursor) AS finalized, greatest(0, max(block_cursor) - 500) AS purge_before FROM v_tx GROUP BY ALL HAVING max(block_cursor) > 1500")
def finality_trigger(spark, d):
    heads = view(spark, d, "v_tx").groupBy("chain", "network").agg(F.max("block_cursor").alias("finalized"))
    last = view(spark, d, "v_chain").select("chain", "network", F.lit(1500).cast("long").alias("finalized"))
    return finality.finality_triggers(heads, last, 500)


# planning and control -----------------------------------------------------------------------------------------------


@query("v_tx", "SELECT chain, network, m + 1 AS start_block, least(h, m + 100) AS end_block FROM (SELECT chain, network, max(block_cursor) FILTER (WHERE block_cursor < 1500) AS m, max(block_cursor) AS h FROM v_tx GROUP BY ALL) x WHERE m + 1 <= h")
def block_range_plan(spark, d):
    marks = view(spark, d, "v_tx").groupBy("chain", "network").agg(F.max(F.when(F.col("block_cursor") < FORK, F.col("block_cursor"))).alias("ingested_sequence"), F.max("block_cursor").alias("head"))
    return control.planned_ranges(marks, 100)


@query("v_tx", "SELECT chain, tx_hash, (row_number() OVER (PARTITION BY chain ORDER BY block_cursor, tx_hash) - 1) // 250 AS sub_batch FROM v_tx")
def sub_batches(spark, d):
    return control.sub_batches(view(spark, d, "v_tx"), ["chain"], ["block_cursor", "tx_hash"], 250).select("chain", "tx_hash", "sub_batch")


@query("v_signal", """SELECT ordinal, CAST(sum(CASE WHEN is_error THEN 1 ELSE 0 END) OVER w * 10000 // count(*) OVER w AS BIGINT) AS error_bps FROM v_signal WINDOW w AS (PARTITION BY chain ORDER BY ts, ordinal ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)""")
def rpc_error_bps(spark, d):
    return control.error_bps(view(spark, d, "v_signal")).select("ordinal", "error_bps")


@query("v_signal", "SELECT ordinal, list_sort(l)[CAST(ceil(len(l) * 95 / 100) AS BIGINT)] AS p95 FROM (SELECT ordinal, list(latency) OVER (PARTITION BY chain ORDER BY ts, ordinal ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS l FROM v_signal) x")
def commit_p95(spark, d):
    return control.commit_p95(view(spark, d, "v_signal")).select("ordinal", "p95")


@query("v_signal", """SELECT ordinal, p95, CAST(count(*) FILTER (WHERE is_error) OVER (PARTITION BY chain, g ORDER BY ts, ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures_in_row FROM (
    SELECT *, list_sort(list(latency) OVER w)[(len(list(latency) OVER w) * 95 - 1) // 100 + 1] AS p95, count(*) FILTER (WHERE NOT is_error) OVER (PARTITION BY chain ORDER BY ts, ordinal ROWS UNBOUNDED PRECEDING) AS g
    FROM v_signal WINDOW w AS (PARTITION BY chain ORDER BY ts, ordinal ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) x""")  # fmt: skip
def health_p95(spark, d):
    return control.health(view(spark, d, "v_signal")).select("ordinal", "p95", "failures_in_row")


_MESSAGES = "CASE event_type WHEN 'error' THEN '429 Too Many Requests' WHEN 'click' THEN 'request Timeout' WHEN 'view' THEN 'HTTP status 503' WHEN 'purchase' THEN 'Connection reset by peer' ELSE 'invalid params' END"


@query("v_signal", f"""SELECT message, count(*) AS n, CASE message WHEN '429 Too Many Requests' THEN 'rate_limited' WHEN 'request Timeout' THEN 'timeout' WHEN 'HTTP status 503' THEN 'server_error' WHEN 'Connection reset by peer' THEN 'network_error' ELSE 'client_error' END AS rpc_kind,
    CASE WHEN message = 'invalid params' THEN 'terminal' ELSE 'transient' END AS retry_class FROM (SELECT {_MESSAGES} AS message FROM v_signal) x GROUP BY message""")  # fmt: skip
def error_classify(spark, d):
    m = view(spark, d, "v_signal").select(F.expr(_MESSAGES).alias("message")).groupBy("message").agg(F.count("*").alias("n"))
    return m.select("message", "n", control.rpc_error("message").alias("rpc_kind"), control.retry_class("message")["class"].alias("retry_class"))


@query("v_watched", "SELECT chain, address AS config_key, CASE WHEN created_at % 3 = 0 THEN NULL ELSE wallet_id END AS old_value, label AS new_value FROM v_watched WHERE created_at % 3 = 0 OR created_at % 3 = 1")
def config_diff(spark, d):
    w = view(spark, d, "v_watched").select("chain", "network", F.col("address").alias("config_key"), "label", "wallet_id", "created_at")
    was = w.where("created_at % 3 <> 0").select("chain", "network", "config_key", F.when(F.col("created_at") % 3 == 1, F.col("wallet_id")).otherwise(F.col("label")).alias("config_value"))
    return control.config_changes(was, w.select("chain", "network", "config_key", F.col("label").alias("config_value"))).select("chain", "config_key", "old_value", "new_value")


@query("v_signal", "SELECT ordinal, CASE WHEN ordinal % 3 = 0 THEN CASE WHEN latency BETWEEN 1 AND 10000 THEN CAST(latency AS STRING) END WHEN ordinal % 3 = 1 THEN CASE WHEN event_type = 'error' THEN 'true' END ELSE CASE WHEN latency > 0 THEN CAST(latency AS STRING) END END AS applied FROM v_signal")
def config_validate(spark, d):
    s = view(spark, d, "v_signal").select("ordinal", F.expr("CASE ordinal % 3 WHEN 0 THEN 'batch_size' WHEN 1 THEN ' is_active' ELSE 'indexing_interval_ms' END").alias("k"), F.expr("CASE ordinal % 3 WHEN 1 THEN CASE event_type WHEN 'error' THEN ' YES ' ELSE 'perhaps' END ELSE cast(latency as string) END").alias("v"))
    return s.select("ordinal", control.valid_config("k", "v").alias("applied"))


_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY chain ORDER BY ts, ordinal) AS n FROM v_signal"


@query("v_signal", f"""WITH RECURSIVE s AS MATERIALIZED ({_NUMBERED}), r AS (
    SELECT chain, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS VARCHAR) AS kind, CAST(MAP {{}} AS MAP(VARCHAR, TIMESTAMP)) AS last, CAST(NULL AS VARCHAR) AS before, FALSE AS sent FROM (SELECT DISTINCT chain FROM s) a
    UNION ALL SELECT chain, n, ordinal, kind, CASE WHEN send THEN map_concat(last, MAP {{kind: ts}}) ELSE last END, CASE WHEN send THEN kind ELSE before END, send FROM (
      SELECT s.chain, s.n, s.ordinal, s.event_type AS kind, s.ts, r.last, r.before, coalesce(r.before <> s.event_type, FALSE) OR r.last[s.event_type] IS NULL OR date_diff('millisecond', r.last[s.event_type], s.ts) >= 300000 AS send
      FROM r JOIN s ON s.chain = r.chain AND s.n = r.n + 1) x)
    SELECT ordinal, chain, kind AS alert_type FROM r WHERE sent""")  # fmt: skip
def alert_cooldown(spark, d):
    s = view(spark, d, "v_signal").select("chain", "network", F.col("event_type").alias("alert_type"), "ts", "ordinal")
    return control.sent_alerts(s).where("sent").select("ordinal", "chain", "alert_type")


@query("v_signal", f"""WITH RECURSIVE s AS MATERIALIZED ({_NUMBERED}), r AS (
    SELECT chain, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ordinal, 'closed' AS state, 0 AS bad, 0 AS good, CAST(NULL AS TIMESTAMP) AS last, TRUE AS allowed FROM (SELECT DISTINCT chain FROM s) a
    UNION ALL SELECT chain, n, ordinal, CASE WHEN allowed AND is_error AND (now = 'half_open' OR bad + 1 >= 2) THEN 'open' WHEN allowed AND NOT is_error AND now = 'half_open' AND own + 1 >= 2 THEN 'closed' ELSE now END,
      CASE WHEN NOT allowed THEN bad WHEN is_error THEN bad + 1 ELSE 0 END, CASE WHEN NOT allowed THEN own WHEN is_error THEN 0 WHEN now = 'half_open' THEN own + 1 ELSE own END, CASE WHEN allowed AND is_error THEN ts ELSE last END, allowed
    FROM (SELECT *, now <> 'open' AS allowed FROM (SELECT s.chain, s.n, s.ordinal, s.ts, s.is_error, r.bad, r.last, CASE WHEN r.state = 'open' AND s.ts - r.last > INTERVAL 600 seconds THEN 'half_open' ELSE r.state END AS now,
      CASE WHEN r.state = 'open' AND s.ts - r.last > INTERVAL 600 seconds THEN 0 ELSE r.good END AS own FROM r JOIN s ON s.chain = r.chain AND s.n = r.n + 1) x) y)
    SELECT ordinal, allowed, state FROM r WHERE n > 0""")  # fmt: skip
def circuit_breaker(spark, d):
    return control.breaker(view(spark, d, "v_signal"), failures=2, open_s=600).select("ordinal", "allowed", "state")


@query("v_signal", """WITH RECURSIVE s AS MATERIALIZED (SELECT chain, address, ordinal, CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS failures, latency > 500 AS wide, row_number() OVER (PARTITION BY chain, address ORDER BY ordinal) AS n FROM v_signal),
    r AS (SELECT chain, address, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ordinal, CAST(100 AS BIGINT) AS size, CAST(100 AS BIGINT) AS asked FROM (SELECT DISTINCT chain, address FROM s) a
    UNION ALL SELECT s.chain, s.address, s.n, s.ordinal, CASE WHEN s.failures = 2 AND r.size > 10 THEN greatest(10, greatest(10, r.size // 2) // 2) WHEN s.failures = 1 AND r.size > 10 THEN greatest(10, r.size // 2)
      WHEN s.wide AND r.size < 100 THEN least(100, 2 * r.size) ELSE r.size END, r.size FROM r JOIN s ON s.chain = r.chain AND s.address = r.address AND s.n = r.n + 1)
    SELECT ordinal, asked AS batch_size FROM r WHERE n > 0""")  # fmt: skip
def adaptive_batch(spark, d):
    failures = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    s = view(spark, d, "v_signal").select("chain", "network", "address", "ordinal", failures.alias("failures"), (F.col("latency") > 500).alias("full"))
    return control.adaptive_batches(s).select("ordinal", "batch_size")


_TICKS = """SELECT chain, ordinal, ordinal % 29 < 25 AS has_lag, ordinal + latency % 700 AS head, CASE WHEN ordinal % 31 = 0 THEN ordinal + 5000 ELSE ordinal END AS cursor, CAST(latency % 100 AS BIGINT) AS queue_depth,
    CAST(100 AS BIGINT) AS queue_capacity, CAST(CASE WHEN ordinal % 17 = 0 THEN 300 ELSE 0 END AS BIGINT) AS error_bps, CAST(CASE WHEN ordinal % 19 = 0 THEN 400 ELSE 5 END AS BIGINT) AS p95,
    CAST(CASE WHEN ordinal % 211 < 2 THEN 150 ELSE 0 END AS BIGINT) AS override, CAST(CASE WHEN ordinal % 97 = 0 THEN 3 ELSE 0 END AS BIGINT) AS policy_hold FROM v_signal"""


@query("v_signal", f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY ordinal) AS n FROM ({_TICKS}) t), r AS (
    SELECT chain, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ordinal, CAST(100 AS BIGINT) AS batch, 0 AS streak, 0 AS side, 0 AS applied, 0 AS sat, 0 AS wait, 0 AS stale, 0 AS back, FALSE AS armed, FALSE AS lost, 0 AS rel, CAST(0 AS BIGINT) AS pol, CAST(0 AS BIGINT) AS ov, '' AS decision
    FROM (SELECT DISTINCT chain FROM s) a
    UNION ALL SELECT chain, n, ordinal, CASE WHEN mode = 1 THEN greatest(10, least(200, ov)) WHEN act THEN next ELSE batch END,
      CASE WHEN mode > 0 OR want = 0 OR capped OR act THEN 0 ELSE run END, CASE WHEN mode > 0 THEN 0 ELSE want END, CASE WHEN mode > 0 THEN 0 WHEN act AND next <> batch THEN want ELSE applied END,
      CASE WHEN mode > 0 OR want = 0 THEN 0 WHEN act THEN CASE WHEN next = batch OR (want = 1 AND next >= 200) OR (want = -1 AND next <= 10) THEN want ELSE 0 END ELSE sat1 END,
      CASE WHEN mode > 0 THEN 0 WHEN act AND next <> batch THEN 3 ELSE greatest(0, wait - 1) END, stale, CASE WHEN tele = 2 AND back >= 2 THEN 0 ELSE back END, armed, CASE WHEN tele = 2 AND back >= 2 THEN FALSE ELSE lost END,
      CASE WHEN mode = 2 THEN rel - 1 ELSE rel END, CASE WHEN mode = 3 THEN pol - 1 ELSE pol END, ov,
      CASE mode WHEN 1 THEN 'hold_operator_override' WHEN 2 THEN 'hold_operator_release' WHEN 3 THEN 'hold_policy_transition' ELSE CASE WHEN want = 0 THEN CASE tele WHEN 1 THEN 'hold_telemetry_stale' WHEN 2 THEN 'hold_telemetry_recovery' ELSE 'hold' END
        WHEN blocked THEN 'defer_cooldown' WHEN NOT capped AND NOT act THEN 'defer_hysteresis' ELSE concat(CASE WHEN act AND next <> batch THEN 'apply_' ELSE 'clamped_' END, CASE want WHEN 1 THEN 'increase' ELSE 'decrease' END) END END
    FROM (SELECT *, mode = 0 AND want <> 0 AND NOT blocked AND NOT capped AND run >= 2 AS act FROM (SELECT *, want <> 0 AND NOT blocked AND sat1 = want AS capped FROM (
      SELECT *, want <> 0 AND wait > 0 AND applied = -want AND NOT critical AS blocked, CASE WHEN side = want THEN streak + 1 ELSE 1 END AS run, greatest(10, least(200, batch + CASE want WHEN 1 THEN 20 ELSE -10 END)) AS next,
        CASE WHEN want <> 0 AND want = sat AND ((want = 1 AND batch >= 200) OR (want = -1 AND batch <= 10)) THEN sat ELSE 0 END AS sat1,
        CASE WHEN ov > 0 THEN 1 WHEN rel > 0 THEN 2 WHEN pol > 0 THEN 3 ELSE 0 END AS mode FROM (
      SELECT *, CASE WHEN tele <> 0 THEN 0 WHEN critical OR queue_depth >= 80 THEN -1 WHEN has_lag AND greatest(0, head - cursor) >= 500 THEN 1 WHEN has_lag AND greatest(0, head - cursor) <= 100 AND queue_depth <= 30 THEN -1 ELSE 0 END AS want FROM (
      SELECT *, CASE WHEN NOT armed THEN 0 WHEN wrong THEN CASE WHEN lost THEN 1 ELSE 0 END WHEN lost THEN 2 ELSE 0 END AS tele FROM (
      SELECT s.chain, s.n, s.ordinal, s.has_lag, s.head, s.cursor, s.queue_depth, s.override AS ov, s.error_bps >= 250 OR s.p95 >= 250 AS critical, r.batch, r.armed OR s.has_lag AS armed, NOT s.has_lag OR s.head < s.cursor AS wrong,
        CASE WHEN NOT (r.armed OR s.has_lag) THEN r.stale WHEN NOT s.has_lag OR s.head < s.cursor THEN r.stale + 1 ELSE 0 END AS stale, r.lost OR ((r.armed OR s.has_lag) AND (NOT s.has_lag OR s.head < s.cursor) AND r.stale + 1 >= 3) AS lost,
        CASE WHEN NOT s.has_lag OR s.head < s.cursor OR NOT r.lost THEN 0 ELSE r.back + 1 END AS back, CASE WHEN r.ov > 0 AND s.override = 0 THEN 2 ELSE r.rel END AS rel, greatest(r.pol, s.policy_hold) AS pol,
        CASE WHEN r.ov > 0 AND s.override = 0 THEN 0 ELSE r.streak END AS streak, CASE WHEN r.ov > 0 AND s.override = 0 THEN 0 ELSE r.side END AS side, CASE WHEN r.ov > 0 AND s.override = 0 THEN 0 ELSE r.applied END AS applied,
        CASE WHEN r.ov > 0 AND s.override = 0 THEN 0 ELSE r.sat END AS sat, CASE WHEN r.ov > 0 AND s.override = 0 THEN 0 ELSE r.wait END AS wait
      FROM r JOIN s ON s.chain = r.chain AND s.n = r.n + 1) a1) a2) a3) a4) a5) a6)
    SELECT ordinal, batch AS batch_size, decision FROM r WHERE n > 0""")  # fmt: skip
def autotune(spark, d):
    view(spark, d, "v_signal").createOrReplaceTempView("_ticks_of")
    ticks = spark.sql(_TICKS.replace("v_signal", "_ticks_of"))
    return control.autotune(ticks, control.Tuning(most=200, cooldown=3)).select("ordinal", "batch_size", "decision")


# serving ------------------------------------------------------------------------------------------------------------


@query("v_event v_watched v_token", """WITH b AS (SELECT chain, network, address, contract, balance_type, CAST(sum(c) AS BIGINT) AS amount FROM (SELECT *, '' AS balance_type, delta_n AS c FROM v_event WHERE applied UNION ALL SELECT *, 'staked', -delta_n FROM v_event WHERE applied AND category = 'STAKE') x GROUP BY ALL)
    SELECT w.chain, w.network, w.address, w.label, coalesce(t.symbol, '') AS symbol, coalesce(b.balance_type, '') AS balance_type, coalesce(CAST(b.amount AS STRING), '0') AS amount FROM (SELECT * FROM v_watched WHERE is_active) w
    LEFT JOIN b USING (chain, network, address) LEFT JOIN v_token t ON b.contract = t.contract""")  # fmt: skip
def balance_summary(spark, d):
    return serving.balance_rows(view(spark, d, "v_watched"), liquid(spark, d), tokens_by_chain(spark, d)).select("chain", "network", "address", "label", "symbol", "balance_type", "amount")


@query("v_event v_watched", """WITH b AS (SELECT DISTINCT chain, network, address, contract, balance_type FROM (SELECT *, '' AS balance_type FROM v_event WHERE applied UNION ALL SELECT *, 'staked' FROM v_event WHERE applied AND category = 'STAKE') x)
    SELECT w.chain, w.network, w.address, count(b.contract) AS n_balances FROM (SELECT * FROM v_watched WHERE is_active) w LEFT JOIN b USING (chain, network, address) GROUP BY ALL""")  # fmt: skip
def balance_documents(spark, d):
    folded = serving.balance_summary(view(spark, d, "v_watched"), liquid(spark, d), tokens_by_chain(spark, d))
    return folded.select("chain", "network", "address", F.size("balances").cast("long").alias("n_balances"))


@query("v_event v_token", """SELECT e.event_id, e.block_cursor, t.symbol, (SELECT count(*) FROM v_event WHERE chain = 'base') AS total FROM (SELECT * FROM v_event WHERE chain = 'base' ORDER BY block_cursor DESC, event_id LIMIT 50 OFFSET 100) e LEFT JOIN v_token t ON e.contract = t.contract""")
def recent_events(spark, d):
    return serving.recent_events(ledger(spark, d), tokens_by_chain(spark, d), "base", "mainnet", limit=999, offset=100).select("event_id", "block_cursor", "symbol", "total")


@query("v_tx v_watched", "SELECT chain, network, max(block_cursor) AS ingested_sequence, (SELECT count(*) FROM v_watched WHERE is_active) AS active_addresses FROM v_tx GROUP BY chain, network")
def overview(spark, d):
    marks = view(spark, d, "v_tx").groupBy("chain", "network").agg(F.max("block_cursor").alias("ingested_sequence"))
    return serving.overview(marks, view(spark, d, "v_watched"))


@query("v_event", "SELECT event_id, block_cursor, event_path FROM v_event WHERE chain = 'ethereum' AND block_cursor BETWEEN 1000 AND 1200")
def events_by_range(spark, d):
    return serving.events_in_range(ledger(spark, d).withColumn("tx_index", F.lit(0)), "ethereum", "mainnet", 1000, 1200).select("event_id", "block_cursor", "event_path")


@query("v_watched", "SELECT chain, address, label FROM v_watched WHERE is_active")
def active_watched(spark, d):
    return serving.active_watched(view(spark, d, "v_watched")).select("chain", "address", "label")


@query("v_event", "SELECT chain, contract, balance_type, CAST(sum(c) AS BIGINT) AS amount FROM (SELECT *, '' AS balance_type, delta_n AS c FROM v_event WHERE applied UNION ALL SELECT *, 'staked', -delta_n FROM v_event WHERE applied AND category = 'STAKE') x WHERE address = 'addr7' AND chain = 'base' GROUP BY ALL")
def balances_of_address(spark, d):
    return serving.balances_of(liquid(spark, d), "base", "mainnet", "addr7").select("chain", "contract", "balance_type", long("amount", "amount"))


@query("v_event_raw v_token", "SELECT DISTINCT r.chain, r.contract, t.is_denied FROM v_event_raw r JOIN v_token t ON r.contract = t.contract")
def denied_map(spark, d):
    wanted = view(spark, d, "v_event_raw").select("chain", "network", "contract").distinct()
    return serving.denied(wanted, tokens_by_chain(spark, d)).select("chain", "contract", "is_denied")


@query("v_event_raw", "SELECT chain, network, tx_hash, count(*) AS n FROM v_event_raw GROUP BY ALL HAVING count(*) > 1")
def duplicate_hashes(spark, d):
    return serving.duplicate_hashes(view(spark, d, "v_event_raw"))


@query("v_event", "SELECT chain, address, contract, CAST(sum(delta_n) AS BIGINT) AS amount FROM v_event WHERE applied GROUP BY ALL HAVING sum(delta_n) < 0")
def negative_balances(spark, d):
    return serving.negative_balances(liquid(spark, d).where("balance_type = ''")).select("chain", "address", "contract", long("amount", "amount"))


@query("v_tx", "SELECT count(*) AS n FROM v_tx WHERE tx_hash LIKE '0xTX1%'")
def prefix_count(spark, d):
    return serving.prefixed_count(view(spark, d, "v_tx"), "0xTX1")


@query("v_event_raw", "SELECT ordinal, CASE WHEN out THEN -amount ELSE amount END AS delta, CASE WHEN out THEN 'WITHDRAWAL' ELSE 'DEPOSIT' END AS activity FROM (SELECT event_id AS ordinal, abs(delta_n) AS amount, delta_n < 0 AS out FROM v_event_raw) x")
def legacy_transfer_case(spark, d):
    t = view(spark, d, "v_event_raw").select(F.col("event_id").alias("ordinal"), F.abs("delta_n").alias("amount"), F.when(F.col("delta_n") < 0, "outgoing").otherwise("incoming").alias("direction"))
    return serving.legacy_transfers(t).select("ordinal", "delta", "activity")


@query("v_event_raw", "SELECT event_id, max(created_at) AS created_at FROM v_event_raw WHERE outer_index > 1 GROUP BY event_id UNION ALL SELECT '', created_at FROM v_event_raw WHERE outer_index <= 1")
def migration_dedup(spark, d):
    e = view(spark, d, "v_event_raw").select(F.when(F.col("outer_index") > 1, F.col("event_id")).otherwise("").alias("event_id"), "created_at", "block_time", F.struct("delta_n", "contract").alias("id"))
    return serving.migrated_dedup(e).select("event_id", "created_at")


@query("v_event", "SELECT chain, count(*) AS n FROM v_event WHERE CAST(block_time AS DATE) >= DATE '2000-01-31' GROUP BY chain")
def retention_days(spark, d):
    return serving.retention(ledger(spark, d), F.lit("2001-01-30").cast("date"), 365).groupBy("chain").agg(F.count("*").alias("n"))


# verification -------------------------------------------------------------------------------------------------------


def _replayed(spark, d):
    return ledger(spark, d).where("outer_index <> 5").select(
        F.when(F.col("outer_index") == 6, F.concat(F.lit("x"), "event_id")).otherwise(F.col("event_id")).alias("event_id"), F.when(F.col("outer_index") == 4, F.concat("delta", F.lit("0"))).otherwise(F.col("delta")).alias("delta"), "address", "activity",
        F.col("contract"), "block_cursor", "tx_hash", "ordinal",
    )


@query("v_event", """SELECT event_id, CASE outer_index WHEN 4 THEN 'divergent' WHEN 5 THEN 'missing' WHEN 6 THEN 'missing' ELSE 'matching' END AS outcome, CASE outer_index WHEN 4 THEN 'delta' ELSE '' END AS fields FROM v_event
    UNION ALL SELECT concat('x', event_id), 'extra', '' FROM v_event WHERE outer_index = 6""")  # fmt: skip
def replay_compare(spark, d):
    return verify.compared(ledger(spark, d).withColumn("program_id", F.col("contract")), _replayed(spark, d))


@query("v_event", "SELECT CASE outer_index WHEN 4 THEN 'divergent' WHEN 5 THEN 'missing' WHEN 6 THEN 'missing' ELSE 'matching' END AS outcome, count(*) AS n FROM v_event GROUP BY 1 UNION ALL SELECT 'extra', count(*) FROM v_event WHERE outer_index = 6")
def replay_report(spark, d):
    return verify.report(verify.compared(ledger(spark, d).withColumn("program_id", F.col("contract")), _replayed(spark, d)))


_RECONCILED = """WITH b AS MATERIALIZED (SELECT chain, network, address, contract, balance_type, CAST(sum(c) AS BIGINT) AS amount FROM (SELECT *, '' AS balance_type, delta_n AS c FROM v_event WHERE applied UNION ALL SELECT *, 'staked', -delta_n FROM v_event WHERE applied AND category = 'STAKE') x GROUP BY ALL),
    o AS MATERIALIZED (SELECT chain, network, address, contract, CASE amount % 4 WHEN 0 THEN CAST(amount AS STRING) WHEN 1 THEN CAST(amount + 1 AS STRING) ELSE 'odd' END AS balance FROM b WHERE balance_type = '' AND amount % 4 <> 3),
    r AS MATERIALIZED (SELECT w.chain, w.network, w.address, coalesce(b.contract, '') AS contract, coalesce(b.balance_type, '') AS balance_type, coalesce(CAST(b.amount AS STRING), '0') AS db_balance FROM v_watched w LEFT JOIN b USING (chain, network, address) WHERE w.is_active),
    z AS (SELECT r.*, o.balance, TRY_CAST(o.balance AS BIGINT) AS n FROM r LEFT JOIN o USING (chain, network, address, contract))"""


def _reconciled(spark, d):
    b = liquid(spark, d)
    n = F.col("amount")
    chain = b.where("balance_type = '' and amount % 4 <> 3").select("chain", "network", "address", "contract", F.when(n % 4 == 0, n.cast("string")).when(n % 4 == 1, (n + 1).cast("string")).otherwise("odd").alias("balance"))
    return verify.reconciled(view(spark, d, "v_watched"), b, chain)


@query("v_event v_watched", _RECONCILED + """ SELECT chain, address, contract, balance_type, db_balance, coalesce(balance, 'ERROR') AS on_chain_balance, CASE WHEN balance IS NULL THEN 'N/A' WHEN n IS NULL THEN 'PARSE_ERROR' ELSE CAST(n - CAST(db_balance AS BIGINT) AS STRING) END AS difference,
    CASE WHEN balance IS NULL THEN FALSE WHEN n IS NULL THEN balance = db_balance ELSE n = CAST(db_balance AS BIGINT) END AS is_match FROM z""")  # fmt: skip
def reconcile(spark, d):
    return _reconciled(spark, d).drop("network")


@query("v_event v_watched", _RECONCILED + " SELECT chain, network, count(*) AS checked, count(*) FILTER (WHERE n = CAST(db_balance AS BIGINT)) AS matched, count(*) FILTER (WHERE balance IS NULL) AS errors FROM z GROUP BY ALL")
def reconcile_totals(spark, d):
    return verify.reconciliation_totals(_reconciled(spark, d))


# scans --------------------------------------------------------------------------------------------------------------


@query("v_tx v_watched v_event_raw", "SELECT t.tx_hash, t.block_cursor AS block_number FROM v_tx t WHERE t.fee_payer IN (SELECT address FROM v_watched WHERE is_active) OR t.tx_hash IN (SELECT tx_hash FROM v_event_raw WHERE counterparty = 'sup7')")
def block_scan(spark, d):
    t = view(spark, d, "v_tx")
    pairs = view(spark, d, "v_event_raw").where("counterparty = 'sup7'").select("tx_hash", F.lit("sup7").alias("to")).distinct()
    txs = t.join(pairs, "tx_hash", "left").select("tx_hash", F.col("block_cursor").alias("block_number"), F.lit(0).alias("tx_index"), "block_time", F.col("fee_payer").alias("from"), F.coalesce("to", F.lit("")).alias("to"))
    logs = spark.createDataFrame([], "tx_hash string, block_number long, tx_index int, topics array<string>")
    watched = view(spark, d, "v_watched").where("is_active").select("address").unionAll(spark.createDataFrame([("sup7",)], "address string"))
    return evm.scan(txs, logs, watched).select("tx_hash", "block_number")


def _utxo(spark, d):
    """Inputs spend the output of the order two numbers before."""
    e = view(spark, d, "v_tx").select(F.col("ordinal").cast("string").alias("txid"), "ordinal", "fee_payer", F.expr("cast(fee_amount as bigint)").alias("value"))
    outs = e.select("txid", F.lit(0).alias("n"), F.col("fee_payer").alias("address"), F.col("value").alias("value_sat"))
    ins = e.select("txid", F.lit(0).alias("index"), (F.col("ordinal") - 2).cast("string").alias("prev_txid"), F.lit(0).alias("prev_vout"), F.lit(None).cast("string").alias("address"), F.lit(None).cast("string").alias("value_sat"), (F.col("ordinal") % 10 == 0).alias("coinbase"))
    return e, ins, outs


@query("v_tx", "SELECT CAST(a.ordinal AS STRING) AS txid, b.fee_payer AS address, coalesce(CAST(b.fee_amount AS BIGINT), 0) AS value_sat, b.ordinal IS NOT NULL AS found FROM v_tx a LEFT JOIN v_tx b ON b.ordinal = a.ordinal - 2")
def utxo_prevout_join(spark, d):
    _, ins, outs = _utxo(spark, d)
    return btc.resolved_inputs(ins, outs.withColumn("value_sat", F.col("value_sat").cast("string"))).select("txid", "address", "value_sat", "found")


@query("v_tx", """SELECT CAST(a.ordinal AS STRING) AS txid, CAST(CASE WHEN a.ordinal % 10 <> 0 AND coalesce(CAST(b.fee_amount AS BIGINT), 0) > 0 AND CAST(b.fee_amount AS BIGINT) >= CAST(a.fee_amount AS BIGINT) THEN CAST(b.fee_amount AS BIGINT) - CAST(a.fee_amount AS BIGINT) ELSE 0 END AS STRING) AS fee_sat,
    CASE WHEN a.ordinal % 10 <> 0 THEN b.fee_payer END AS fee_payer FROM v_tx a LEFT JOIN v_tx b ON b.ordinal = a.ordinal - 2""")  # fmt: skip
def btc_fee(spark, d):
    e, ins, outs = _utxo(spark, d)
    resolved = btc.resolved_inputs(ins, outs.withColumn("value_sat", F.col("value_sat").cast("string")))
    return btc.envelopes(e.select("txid"), resolved, outs).select("txid", "fee_sat", "fee_payer")


@query("v_event_raw v_watched", """WITH RECURSIVE f AS (SELECT tx_hash, outer_index AS i, max(delta_n) AS v, min(address) AS a, min(counterparty) AS b FROM v_event_raw GROUP BY ALL),
    t AS (SELECT tx_hash, i, 0 AS depth, v, a, b FROM f WHERE i = 1 UNION ALL SELECT f.tx_hash, f.i, t.depth + 1, f.v, f.a, f.b FROM f JOIN t ON f.tx_hash = t.tx_hash AND f.i = t.i + 1)
    SELECT tx_hash, i AS frame_id, depth FROM t WHERE i % 3 <> 0 AND (a IN (SELECT address FROM v_watched WHERE is_active) OR b = 'sup7')""")  # fmt: skip
def internal_call_tree(spark, d):
    """Every third frame moves nothing, every fourth failed; parties are those of the events."""
    f = view(spark, d, "v_event_raw").groupBy("tx_hash", F.col("outer_index").alias("frame_id")).agg(F.max("delta_n").alias("v"), F.min("address").alias("from"), F.min("counterparty").alias("to"))
    frames = f.select("tx_hash", "frame_id", F.when(F.col("frame_id") > 1, F.col("frame_id") - 1).alias("parent_id"), "from", "to", F.when(F.col("frame_id") % 3 == 0, 0).otherwise(F.col("v")).alias("value"), (F.col("frame_id") % 4 == 0).alias("failed"))
    watched = _active(spark, d).unionAll(spark.createDataFrame([("sup7",)], "address string"))
    return evm.internal_transfers(frames, watched).select("tx_hash", "frame_id", "depth")


def _payloads(spark, d, body: str, **more: Column) -> DataFrame:
    """Raw payloads made of orders: `body` is a JSON text with names of columns in brackets."""
    t = view(spark, d, "v_tx").withColumns(more).withColumns({"n": F.col("ordinal").cast("string"), "other": F.concat(F.lit("sup"), (F.col("ordinal") % 50).cast("string"))})
    parts = body.replace("[", "\0[").replace("]", "]\0").split("\0")
    text = F.concat(*[F.col(p[1:-1]).cast("string") if p.startswith("[") and p.endswith("]") and p[1:-1] in t.columns else F.lit(p) for p in parts if p])
    return t.select("ordinal", F.lit("base").alias("chain"), F.col("tx_hash").alias("signature"), text.alias("payload"))


def _active(spark, d) -> DataFrame:
    return view(spark, d, "v_watched").where("is_active").select("address")


_EVM = '{"tx":{"hash":"[tx_hash]","blockNumber":"[block_cursor]","from":"[fee_payer]","to":"[other]","value":"[fee_amount]","gasPrice":"[n]"},"receipt":{"status":"0x1","gasUsed":"0x5208","l1Fee":"0x0a","transactionIndex":"0x2"}}'


@query("v_tx", "SELECT tx_hash, block_cursor, fee_payer, CAST(21000 * ordinal + 10 AS STRING) AS fee_amount, 'SUCCESS' AS status, CAST(21000 * ordinal AS STRING) AS fee_execution_l2 FROM v_tx")
def evm_decode(spark, d):
    return evm.transactions(_payloads(spark, d, _EVM)).select("tx_hash", "block_cursor", "fee_payer", "fee_amount", "status", F.element_at("metadata", "fee_execution_l2").alias("fee_execution_l2"))


@query("v_tx v_watched", "SELECT tx_hash, fee_payer AS address, concat('sup', CAST(ordinal % 50 AS STRING)) AS counterparty, concat('-', fee_amount) AS delta, 'tx:2' AS event_path FROM v_tx WHERE fee_payer IN (SELECT address FROM v_watched WHERE is_active)")
def evm_events(spark, d):
    return evm.balance_events(evm.transactions(_payloads(spark, d, _EVM)), _active(spark, d)).select("tx_hash", "address", "counterparty", "delta", "event_path")


_BTC = '{"txid":"[tx_hash]","block_height":[block_cursor],"confirmations":1,"vin":[{"index":0,"address":"[fee_payer]","value_sat":"[fee_amount]"}],"vout":[{"index":1,"address":"[other]","value_sat":"[n]"}]}'


@query("v_tx v_watched", "SELECT tx_hash, fee_payer AS address, concat('-', fee_amount) AS delta, 'vin:0' AS event_path, 'confirmed' AS finality_state FROM v_tx WHERE CAST(fee_amount AS BIGINT) > 0 AND fee_payer IN (SELECT address FROM v_watched WHERE is_active) UNION ALL SELECT tx_hash, 'sup7', CAST(ordinal AS STRING), 'vout:1', 'confirmed' FROM v_tx WHERE ordinal % 50 = 7")
def btc_decode(spark, d):
    watched = _active(spark, d).unionAll(spark.createDataFrame([("sup7",)], "address string"))
    return btc.balance_events(_payloads(spark, d, _BTC), watched).select("tx_hash", "address", "delta", "event_path", "finality_state")


@query("v_tx", "SELECT tx_hash, CAST(CASE WHEN CAST(fee_amount AS BIGINT) > 0 AND CAST(fee_amount AS BIGINT) >= ordinal THEN CAST(fee_amount AS BIGINT) - ordinal ELSE 0 END AS STRING) AS fee_amount, fee_payer FROM v_tx")
def btc_results(spark, d):
    return btc.results(_payloads(spark, d, _BTC)).select("tx_hash", "fee_amount", "fee_payer")


_SOLANA = '{"slot":[block_cursor],"transaction":{"message":{"accountKeys":["[fee_payer]","[other]"],"instructions":[{"programId":"11111111111111111111111111111111","parsed":{"type":"transfer","info":{"source":"[fee_payer]","destination":"1","lamports":[fee_amount]}}}]}},"meta":{"fee":5000}}'


@query("v_tx v_watched", """WITH w AS (SELECT * FROM v_tx WHERE fee_payer IN (SELECT address FROM v_watched WHERE is_active)) SELECT tx_hash AS signature, fee_payer AS address, concat('sup', CAST(ordinal % 50 AS STRING)) AS counterparty, concat('-', fee_amount) AS delta, 'TRANSFER' AS category FROM w WHERE fee_amount <> '0'
    UNION ALL SELECT tx_hash, fee_payer, '', '-5000', 'FEE' FROM w""")  # fmt: skip
def solana_decode(spark, d):
    return solana.balance_events(_payloads(spark, d, _SOLANA), _active(spark, d)).select("signature", "address", "counterparty", "delta", "category")


@query("v_tx v_watched", "SELECT tx_hash AS signature, block_cursor AS slot FROM v_tx WHERE fee_payer IN (SELECT address FROM v_watched WHERE is_active)")
def solana_scan(spark, d):
    p = _payloads(spark, d, _SOLANA).join(view(spark, d, "v_tx").select("ordinal", F.col("block_cursor").alias("slot")), "ordinal")
    return solana.scan(p, _active(spark, d)).select("signature", "slot")


@query("v_tx", "SELECT tx_hash AS signature, CASE ordinal % 3 WHEN 0 THEN 'evm' WHEN 1 THEN 'btc' ELSE 'solana' END AS family FROM v_tx")
def payload_router(spark, d):
    kinds = [_payloads(spark, d, b).where(f"ordinal % 3 = {k}") for k, b in enumerate((_EVM, _BTC, _SOLANA))]
    return kinds[0].unionAll(kinds[1]).unionAll(kinds[2]).select("signature", evm.payload_family(F.col("payload"), F.lit("polygon")).alias("family"))


@query("v_tx", "SELECT tx_hash, CASE ordinal % 2 WHEN 0 THEN '5' ELSE '7' END AS fee_execution_l2, CASE ordinal % 2 WHEN 0 THEN '6' ELSE '8' END AS fee_data_l1, CASE ordinal % 2 WHEN 0 THEN 'log:1' ELSE 'tx:0' END AS path FROM v_tx")
def fee_reconcile(spark, d):
    row = lambda path, *kv: F.struct(F.lit(path).alias("path"), F.create_map(*[F.lit(x) for x in kv]).alias("metadata"))
    both = row("log:1", "fee_execution_l2", "5", "fee_data_l1", "6")
    only = F.array(row("", "fee_execution_l2", "9", "a", "b", "c", "d"), row("tx:0", "fee_execution_l2", "7"), row("", "l1_fee", "8"))
    events = view(spark, d, "v_tx").select("tx_hash", F.explode(F.when(F.col("ordinal") % 2 == 0, F.concat(F.array(both), only)).otherwise(only)).alias("e")).select("tx_hash", "e.*").withColumn("fingerprint", F.col("metadata").cast("string"))
    return canonical.reconciled_fees(events)


@query("v_tx v_watched", """WITH w AS (SELECT ordinal % 10 AS k FROM v_tx WHERE fee_amount <> '0' AND fee_payer IN (SELECT address FROM v_watched WHERE is_active))
    SELECT CASE k WHEN 0 THEN 'extra' WHEN 1 THEN 'divergent' ELSE 'matching' END AS outcome, count(*) AS n FROM w GROUP BY 1 UNION ALL SELECT 'missing', count(*) FROM w WHERE k = 2""")  # fmt: skip
def replay_pipeline(spark, d):
    """The replay of payloads against a ledger made of the transactions themselves, with rows missing, changed and too many."""
    again = verify.replayed(_payloads(spark, d, _EVM), _active(spark, d), "mainnet")
    t = view(spark, d, "v_tx").where("fee_amount <> '0'").join(_active(spark, d), F.col("fee_payer") == F.col("address"), "left_semi")
    parts = [F.lit("chain=base|network=mainnet|tx="), F.lower(F.col("tx_hash")), F.lit("|path=tx:2|actor="), F.col("fee_payer"), F.lit("|asset=ETH|activity=WITHDRAWAL")]
    made = t.select(
        F.sha2(F.concat(*parts), 256).alias("event_id"), F.concat(F.lit("-"), "fee_amount", F.when(F.col("ordinal") % 10 == 1, "0").otherwise("")).alias("delta"), F.col("fee_payer").alias("address"), F.lit("WITHDRAWAL").alias("activity"),
        F.lit("ETH").alias("program_id"), "block_cursor", "tx_hash", "ordinal",
    )
    extra = made.where("ordinal % 10 = 2").withColumn("event_id", F.concat(F.lit("gone"), "event_id"))
    return verify.report(verify.compared(made.where("ordinal % 10 <> 0").unionByName(extra).withColumn("contract", F.col("program_id")), again))


@query("v_event v_watched", "SELECT DISTINCT e.chain, e.address, w.address IS NOT NULL AS is_watched FROM v_event e LEFT JOIN (SELECT * FROM v_watched WHERE is_active) w USING (chain, network, address)".replace("e.address, w.address", "address, w.label").replace("e.chain", "chain"))
def address_lookup(spark, d):
    wanted = ledger(spark, d).select("chain", "network", "address").distinct()
    return ingest.looked_up(wanted, view(spark, d, "v_watched").where("is_active")).select("chain", "address", "is_watched")


@query("v_tx", "SELECT chain, network, min(block_time) AS oldest_block_time FROM v_tx GROUP BY ALL")
def oldest_block_time(spark, d):
    return ingest.oldest_block_time(view(spark, d, "v_tx"))


@query("v_event", "SELECT count(*) AS n, tx_hash FROM v_event WHERE outer_index <= 3 AND tx_hash IN (SELECT tx_hash FROM v_event WHERE outer_index <= 2) GROUP BY tx_hash")
def coverage_floor(spark, d):
    e = ledger(spark, d).select("tx_hash", F.col("event_path").alias("path"), "address", F.concat("contract", F.col("activity")).alias("asset"), "category", "outer_index", F.lit(True).alias("path_hinted"), F.lit(0).alias("n_metadata"), F.lit(0).alias("n_filled"), F.col("event_id").alias("fingerprint"), F.lit(0).alias("ordinal"))
    return canonical.floored(e.where("outer_index <= 2"), e.where("outer_index between 2 and 3")).groupBy("tx_hash").agg(F.count("*").alias("n"))


# metrics ------------------------------------------------------------------------------------------------------------


def _counter(spark, d):
    """A counter that restarts every hundred samples of its chain."""
    s = view(spark, d, "v_signal").where("is_error")
    n = F.row_number().over(Window.partitionBy("chain").orderBy("ts", "ordinal"))
    return s.withColumn("_n", n).select("chain", "ts", ((F.col("_n") % 100) * 10).cast("long").alias("value"))


@query("v_signal", """SELECT chain, window_start, CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END) AS BIGINT) AS increase FROM (
    SELECT chain, time_bucket(INTERVAL 5 minutes, ts) AS window_start, value, lag(value) OVER (PARTITION BY chain ORDER BY ts) AS p FROM (
    SELECT chain, ts, (row_number() OVER (PARTITION BY chain ORDER BY ts, ordinal) % 100) * 10 AS value FROM v_signal WHERE is_error) a) b GROUP BY ALL HAVING increase > 5""")  # fmt: skip
def error_rate_5m(spark, d):
    return metrics.rate_alerts(_counter(spark, d), ["chain"], 5 / 300).select("chain", "window_start", long("increase", "increase"))


@query("v_signal", """SELECT chain, window_start, CAST(sum(CASE WHEN p IS NULL OR p = value THEN 0 ELSE 1 END) AS BIGINT) AS changes FROM (SELECT chain, time_bucket(INTERVAL 10 minutes, ts) AS window_start, value, lag(value) OVER (PARTITION BY chain ORDER BY ts) AS p
    FROM (SELECT chain, ts, latency // 2000 AS value FROM v_signal) a) b GROUP BY ALL HAVING changes = 0""")  # fmt: skip
def cursor_stalled(spark, d):
    s = view(spark, d, "v_signal").select("chain", "ts", F.floor(F.col("latency") / 2000).alias("value"))
    return metrics.stalled(s, ["chain"]).select("chain", "window_start", long("changes", "changes"))


@query("v_signal", """WITH b AS (SELECT chain, le, count(*) FILTER (WHERE latency <= le) AS n FROM v_signal, (VALUES (100), (500), (1000), (5000), (20000), (1000000)) x(le) GROUP BY ALL),
    c AS (SELECT *, lag(n, 1, 0) OVER w AS below, lag(le, 1, 0) OVER w AS low, max(n) OVER (PARTITION BY chain) AS total FROM b WINDOW w AS (PARTITION BY chain ORDER BY le))
    SELECT chain, CAST(round((low + (le - low) * (total * 0.99 - below) / (n - below)) * 1000) AS BIGINT) AS q99_milli FROM c WHERE n >= total * 0.99 AND below < total * 0.99""")  # fmt: skip
def latency_quantile(spark, d):
    bounds = spark.createDataFrame([(float(x),) for x in (100, 500, 1000, 5000, 20000, 1000000)], "le double")
    s = view(spark, d, "v_signal").crossJoin(F.broadcast(bounds)).groupBy("chain", "le").agg(F.count(F.when(F.col("latency") <= F.col("le"), 1)).alias("n"))
    return metrics.histogram_quantile(s, ["chain"], 0.99).select("chain", F.round(F.col("quantile") * 1000).cast("long").alias("q99_milli"))
