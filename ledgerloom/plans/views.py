"""Ledger views over the driver's tables, as SQL that Spark and DuckDB both read but for a few words.

The tables hold no chain data; the views give their rows the shapes that the ledger's operators work on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.shared import deleted, new_path, shared_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    "v_chain": """
        SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'solana' WHEN 1 THEN 'ethereum' WHEN 2 THEN 'base' WHEN 3 THEN 'btc' ELSE 'polygon' END AS chain, 'mainnet' AS network
        FROM region""",
    "v_tx": """
        SELECT o.o_orderkey AS ordinal, c.chain, c.network, concat('0xTX', CAST(o.o_orderkey AS STRING)) AS tx_hash, CAST({days(o.o_orderdate)} AS BIGINT) AS block_cursor,
          CAST(CAST(round(o.o_totalprice) AS BIGINT) AS STRING) AS fee_amount, concat('addr', CAST(o.o_custkey AS STRING)) AS fee_payer,
          CASE o.o_orderstatus WHEN 'F' THEN 'FAILED' ELSE 'SUCCESS' END AS status, o.o_orderdate AS block_time
        FROM orders o JOIN customer k ON o.o_custkey = k.c_custkey JOIN nation n ON k.c_nationkey = n.n_nationkey JOIN v_chain c ON n.n_regionkey = c.r_regionkey""",
    "v_token": """
        SELECT concat('tok', CAST(p_partkey AS STRING)) AS contract, p_brand AS symbol, p_name AS name, 6 AS decimals,
          CASE p_size % 3 WHEN 0 THEN 'NATIVE' WHEN 1 THEN 'FUNGIBLE' ELSE 'NFT' END AS token_type, p_size = 50 AS is_denied
        FROM part""",
    "v_event_base": """
        SELECT t.chain, t.network, t.tx_hash, t.block_cursor, t.block_time, t.fee_payer AS address, concat('sup', CAST(l.l_suppkey AS STRING)) AS counterparty,
          concat('tok', CAST(l.l_partkey AS STRING)) AS contract, CAST(round(l.l_extendedprice * 100) AS BIGINT) * CASE l.l_returnflag WHEN 'R' THEN -1 ELSE 1 END AS delta_n,
          CASE l.l_returnflag WHEN 'N' THEN 'STAKE' ELSE 'TRANSFER' END AS category, CAST(l.l_linenumber AS INT) AS outer_index, -1 AS inner_index,
          CASE WHEN l.l_tax = 0 THEN 'pending' WHEN l.l_linestatus = 'O' THEN 'confirmed' ELSE 'finalized' END AS finality_state, l.l_returnflag AS action, l.l_shipdate AS created_at
        FROM lineitem l JOIN v_tx t ON l.l_orderkey = t.ordinal""",
    "v_event_raw": """
        SELECT b.*, CAST(b.delta_n AS STRING) AS delta, concat('outer:', CAST(b.outer_index AS STRING), '|inner:', CAST(b.inner_index AS STRING)) AS event_path,
          CASE WHEN b.category = 'STAKE' THEN CASE WHEN b.delta_n > 0 THEN 'UNSTAKE' ELSE 'STAKE' END WHEN b.delta_n > 0 THEN 'DEPOSIT' ELSE 'WITHDRAWAL' END AS activity, k.token_type,
          {sha(concat('chain=', b.chain, '|network=', b.network, '|tx=', b.tx_hash, '|path=outer:', CAST(b.outer_index AS STRING), '|inner:', CAST(b.inner_index AS STRING), '|actor=', b.address, '|asset=', '|activity=', CASE WHEN b.category = 'STAKE' THEN CASE WHEN b.delta_n > 0 THEN 'UNSTAKE' ELSE 'STAKE' END WHEN b.delta_n > 0 THEN 'DEPOSIT' ELSE 'WITHDRAWAL' END))} AS event_id
        FROM v_event_base b JOIN v_token k ON b.contract = k.contract""",
    "v_event": """
        SELECT * FROM (
          SELECT r.*, row_number() OVER (PARTITION BY event_id ORDER BY CASE finality_state WHEN 'finalized' THEN 4 WHEN 'confirmed' THEN 2 ELSE 1 END DESC, action, contract, counterparty, delta_n, created_at) AS place,
            CASE WHEN chain = 'solana' OR finality_state <> 'pending' THEN token_type = 'NATIVE' OR delta_n <> 0 ELSE FALSE END AS applied
          FROM v_event_raw r) w WHERE place = 1""",
    "v_watched": """
        SELECT c.chain, c.network, concat('addr', CAST(k.c_custkey AS STRING)) AS address, k.c_name AS label, concat('wallet', CAST(k.c_custkey % 100 AS STRING)) AS wallet_id,
          concat('org', CAST(k.c_custkey % 10 AS STRING)) AS organization_id, k.c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_active,
          CASE WHEN k.c_acctbal < 0 THEN k.c_custkey % 2000 END AS backfill_from_block, k.c_custkey AS created_at
        FROM customer k JOIN nation n ON k.c_nationkey = n.n_nationkey JOIN v_chain c ON n.n_regionkey = c.r_regionkey""",
    "v_block": """
        SELECT chain, network, block_cursor AS block_number, {sha(concat(chain, CAST(block_cursor AS STRING)))} AS block_hash,
          CASE WHEN block_cursor % 97 = 0 THEN {sha(concat('bad', CAST(block_cursor AS STRING)))} ELSE {sha(concat(chain, CAST(block_cursor - 1 AS STRING)))} END AS parent_hash,
          CASE WHEN block_cursor % 3 = 0 THEN 'finalized' ELSE 'pending' END AS finality_state
        FROM (SELECT DISTINCT chain, network, block_cursor FROM v_tx) d""",
    "v_signal": """
        SELECT c.chain, c.network, e.ts, e.event_id AS ordinal, e.event_type, e.event_type = 'error' AS is_error, CAST(round(e.value * 100) AS BIGINT) AS latency, e.props, concat('addr', CAST(e.user_id AS STRING)) AS address
        FROM events e JOIN v_chain c ON e.user_id % 5 = c.r_regionkey""",
}


def _spelled(sql: str, dialect: str) -> str:
    """Puts the dialect's function for each {name(argument)}."""
    forms = {"days": {"spark": ("datediff(", ", DATE '1995-01-01')"), "duckdb": ("date_diff('day', DATE '1995-01-01', CAST(", " AS DATE))")}, "sha": {"spark": ("sha2(", ", 256)"), "duckdb": ("sha256(", ")")}}
    for name, by in forms.items():
        before, after = by[dialect]
        while (at := sql.find("{" + name + "(")) >= 0:
            start, depth, i = at + len(name) + 2, 1, at + len(name) + 2
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[i], 0)
                i += 1
            sql = sql[:at] + before + sql[start : i - 1] + after + sql[i + 1 :]
    return sql


#: Views that are written once a session and folder: the ledger's events, which nearly every query reads.
STORED = ("v_event_raw", "v_event")


def needed(name: str, stored: tuple[str, ...] = ()) -> list[str]:
    """The views under a view, in order, itself last; what is stored needs nothing."""
    out: list[str] = []
    for other in VIEWS:
        if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
            out += [x for x in (needed(other, stored) if other not in stored else [other]) if x not in out]
    return [*out, name]


def prefix(names: list[str], dialect: str, tables: dict[str, str] | None = None) -> str:
    """WITH ... for these views, with tables and stored views read from paths where they are given."""
    known = tables or {}
    views = list(dict.fromkeys(x for n in names for x in needed(n, tuple(v for v in VIEWS if v in known and v != n))))
    parts = [f"{t} AS (SELECT * FROM parquet.`{p}`)" for t, p in known.items()]
    return "WITH " + ", ".join(parts + [f"{v} AS ({_spelled(VIEWS[v], dialect)})" for v in views if v not in known])


def version(spark: SparkSession, sf_dir: str) -> str:
    """Sizes and times of the tables' files: what is stored of other ones is not used."""
    jvm, out = spark._jvm, []
    for t in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            out += [f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(path)]
    return "|".join(out)


def stored(spark: SparkSession, sf_dir: str, name: str) -> str | None:
    """The path of a stored view, written now if it isn't there; None on a cluster that names no shared folder."""
    if shared_dir(spark) is None:
        return None
    sc = spark.sparkContext
    if not hasattr(sc, "_ledgerloom_views"):
        sc._ledgerloom_views = {}
    now = version(spark, sf_dir)
    was, path = sc._ledgerloom_views.get((sf_dir, name), ("", None))
    if was != now:
        deleted(spark, path)
        path = new_path(spark, name)
        below = {v: stored(spark, sf_dir, v) for v in STORED[: STORED.index(name)]}
        _planned(spark, sf_dir, name, below).write.parquet(path)
        sc._ledgerloom_views[sf_dir, name] = (now, path)
    return path


def _planned(spark: SparkSession, sf_dir: str, name: str, below: dict[str, str]) -> DataFrame:
    return spark.sql(f"{prefix([name], 'spark', {t: f'{sf_dir}/{t}.parquet' for t in TABLES} | below)} SELECT * FROM {name}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of a folder; Catalyst prunes what a query doesn't use of it. The ledger's events are read as they were stored."""
    if name in STORED:
        path = stored(spark, sf_dir, name)
        if path:
            return spark.read.parquet(path)
    return _planned(spark, sf_dir, name, {})


def duckdb_sql(names: list[str], select: str) -> str:
    """A statement over views; its own WITH clause follows theirs."""
    head, body = prefix(names, "duckdb"), _spelled(select, "duckdb").strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE{head.removeprefix('WITH')}, {body.removeprefix('WITH RECURSIVE ')}"
    return f"{head}, {body.removeprefix('WITH ')}" if body.startswith("WITH ") else f"{head} {body}"
