"""Scalar rules of the ledger as Column -> Column functions: identities, classification, amounts, finality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chains by family, staking activities, default finality by chain.
EVM_CHAINS = ("base", "ethereum", "polygon", "arbitrum", "bsc")
STAKING = ("STAKE", "UNSTAKE")
L2_CHAINS = ("base", "arbitrum")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at both ends (SQL trim() takes plain spaces only)."""
    return F.regexp_replace(col(c), r"^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def is_evm(chain: Column | str) -> Column:
    return col(chain).isin(*EVM_CHAINS)


def is_hex(c: Column | str) -> Column:
    return col(c).rlike("^[0-9a-fA-F]*$")


def without_0x(c: Column) -> Column:
    """One `0x` and then one `0X` taken off the front."""
    return F.regexp_replace(c, "^(0x)?(0X)?", "")


def signature_identity(chain: Column | str, value: Column | str) -> Column:
    """The identity under which spellings of one transaction hash meet."""
    v = stripped(value)
    bare = without_0x(v)
    prefixed = v.startswith("0x") | v.startswith("0X")
    evm = F.when(prefixed | (is_hex(bare) & (bare != "")), F.when(bare == "", "").otherwise(F.concat(F.lit("0x"), F.lower(bare)))).otherwise(v)
    return F.when(col(chain) == "btc", F.lower(bare)).when(is_evm(chain), evm).otherwise(v)


def address_identity(chain: Column | str, value: Column | str) -> Column:
    """As I1 for account-based chains, but a bare 0x stays; others are only trimmed."""
    v = stripped(value)
    bare = without_0x(v)
    prefixed = v.startswith("0x") | v.startswith("0X")
    evm = F.when(v == "", v).when(prefixed | is_hex(bare), F.concat(F.lit("0x"), F.lower(bare))).otherwise(v)
    return F.when(is_evm(chain), evm).otherwise(v)


def decoded_address_identity(chain: Column | str, value: Column | str) -> Column:
    """I1 for account-based chains where it leaves something, else trimmed."""
    v = stripped(value)
    return F.when(is_evm(chain), F.coalesce(F.nullif(signature_identity(chain, value), F.lit("")), v)).otherwise(v)


def watched_address_identity(chain: Column | str, value: Column | str) -> Column:
    """I4: I2, but a bare 0x is nothing."""
    v = address_identity(chain, value)
    return F.when(is_evm(chain) & (v == "0x"), "").otherwise(v)


def cursor_value(chain: Column | str, value: Column | str) -> Column:
    """I1 with blank as null."""
    return F.nullif(signature_identity(chain, value), F.lit(""))


def is_integer(c: Column | str) -> Column:
    """Whether a string is a signed decimal integer; casts alone would take 1e3 and round 1.9."""
    return F.coalesce(col(c).rlike("^[+-]?[0-9]+$"), F.lit(False))


def integer(c: Column | str) -> Column:
    """The integer of a string as DECIMAL(38,0); null if it is none or too long."""
    return F.when(is_integer(c), col(c).try_cast("decimal(38,0)"))


def negated(c: Column | str) -> Column:
    """A decimal string negated exactly, at any length; null if it is no integer (no trimming)."""
    digits = F.regexp_replace(F.regexp_replace(col(c), "^[+-]", ""), "^0+(?=[0-9])", "")
    return F.when(is_integer(c), F.when(digits == "0", "0").when(col(c).startswith("-"), digits).otherwise(F.concat(F.lit("-"), digits)))


def activity(category: Column | str, delta: Column | str, watched: Column | None = None) -> Column:
    """I8: the activity of a decoded event; zero and unreadable amounts count as going out, unwatched transfers as OTHER."""
    kind = col(category)
    positive = F.coalesce(stripped(delta).rlike("^[+]?0*[1-9][0-9]*$"), F.lit(False))
    same = {"REWARD": "CLAIM_REWARD", "FEE": "FEE", "fee_execution_l2": "FEE_EXECUTION_L2", "fee_data_l1": "FEE_DATA_L1", "SWAP": "SWAP", "MINT": "MINT", "BURN": "BURN"}
    out = F.when(kind == "TRANSFER", F.when(~(F.lit(True) if watched is None else watched), "OTHER").when(positive, "DEPOSIT").otherwise("WITHDRAWAL"))
    out = out.when(kind == "STAKE", F.when(positive, "UNSTAKE").otherwise("STAKE"))
    for name, booked in same.items():
        out = out.when(kind == name, booked)
    return out.otherwise("OTHER")


def event_id(chain, network, tx, path, actor, asset, activity_type) -> Column:
    """The id of a balance event, by content."""
    parts = zip(("chain", "network", "tx", "path", "actor", "asset", "activity"), (chain, network, tx, path, actor, asset, activity_type))
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{name}="), F.coalesce(col(c), F.lit(""))) for name, c in parts]), 256)


def event_path(outer: Column | str, inner: Column | str) -> Column:
    """I10."""
    return F.concat(F.lit("outer:"), col(outer).cast("string"), F.lit("|inner:"), col(inner).cast("string"))


def path_indices(path: Column | str) -> Column:
    """struct(outer, inner) of an instruction path; null unless it has exactly these two parts."""
    p = F.lower(F.regexp_replace(col(path), r"\s+", ""))
    got = lambda i: F.regexp_extract(p, r"^outer[:=](-?[0-9]{1,9})\|inner[:=](-?[0-9]{1,9})$", i)
    return F.when(got(1) != "", F.struct(got(1).try_cast("int").alias("outer"), got(2).try_cast("int").alias("inner")))


def evm_path(metadata: Column, fee: bool = False) -> Column:
    """The first path that the metadata names."""
    named = lambda key: F.nullif(F.trim(F.element_at(metadata, key)), F.lit(""))
    log = lambda key: F.concat(F.lit("log:"), named(key))
    return F.coalesce(named("event_path"), named("log_path"), log("log_index"), log("base_log_index"), named("base_event_path"), F.lit("log:0") if fee else F.lit(None))


def btc_path(metadata: Column, action: Column | str, outer: Column | str, inner: Column | str) -> Column:
    """I13."""
    side = F.when(col(action).startswith("vin"), "vin:").when(col(action).startswith("vout"), "vout:")
    return F.coalesce(F.nullif(F.trim(F.element_at(metadata, "event_path")), F.lit("")), F.concat(side, col(outer).cast("string")), event_path(outer, inner))


def btc_asset(c: Column | str) -> Column:
    """I14."""
    v = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(F.lower(v).isin("", "btc"), "BTC").otherwise(v)


def asset_type(token_type: Column | str, activity_type: Column | str) -> Column:
    """I15."""
    kind = F.upper(col(token_type))
    return F.when(col(activity_type).startswith("FEE"), "fee").when(kind == "NATIVE", "native").when(kind == "NFT", "nft").when(kind == "FUNGIBLE", "fungible_token").otherwise("unknown")


def fee_delta(amount: Column | str) -> Column:
    """I16: the delta string of a fee: its digits with a minus; nothing, zero and unreadable ones give -0."""
    digits = F.regexp_replace(stripped(amount), "^[+-]", "")
    good = F.coalesce(digits.rlike("^[0-9]+$") & ~digits.rlike("^0+$"), F.lit(False))
    return F.when(good, F.concat(F.lit("-"), digits)).otherwise("-0")


def magnitude(c: Column | str) -> Column:
    """The size of an amount; one sign is dropped."""
    return integer(F.regexp_replace(stripped(c), "^[+-]", ""))


def delta_order(c: Column | str) -> Column:
    """Sorts amounts as numbers, unreadable ones after them as strings."""
    n = integer(stripped(c))
    return F.struct(n.isNull().alias("odd"), n.alias("number"), col(c).alias("text"))


def finality(c: Column | str) -> Column:
    """A finality state under its common name; '' if unknown."""
    v = F.lower(stripped(F.coalesce(col(c), F.lit(""))))
    return F.when(v.isin("processed", "pending", "latest", "unsafe"), "processed").when(v.isin("confirmed", "accepted"), "confirmed").when(v == "safe", "safe").when(v.isin("finalized", "finalised"), "finalized").otherwise("")


def _rank(c: Column, **ranks: int) -> Column:
    out = None
    for state, rank in ranks.items():
        out = F.when(c == state, rank) if out is None else out.when(c == state, rank)
    return out.otherwise(0)


def rank_norm(c: Column | str) -> Column:
    """I20 in canonicalisation."""
    return _rank(finality(c), processed=1, confirmed=2, safe=3, finalized=4)


def rank_ingest(c: Column | str) -> Column:
    """I20 when events are applied: no state at all counts as final."""
    return F.when(stripped(F.coalesce(col(c), F.lit(""))) == "", 4).otherwise(rank_norm(c))


def rank_store(c: Column | str) -> Column:
    """I20 in the stored ledger: only these four spellings count."""
    return _rank(col(c), pending=1, confirmed=2, safe=3, finalized=4)


def default_finality(chain: Column | str) -> Column:
    """I21."""
    return F.when(col(chain) == "solana", "finalized").otherwise("confirmed")


def native_symbol(chain: Column | str) -> Column:
    """The symbol under which canonicalisation books native coins."""
    return F.when(col(chain) == "polygon", "POL").when(col(chain) == "bsc", "BNB").when(is_evm(chain), "ETH").when(col(chain) == "btc", "BTC").otherwise("SOL")


def native_contract(chain: Column | str) -> Column:
    """The contract under which ingestion books native coins."""
    return F.when(col(chain) == "solana", "So11111111111111111111111111111111111111112").when(col(chain) == "btc", "btc_native").otherwise("0x0000000000000000000000000000000000000000")


def token_symbol(symbol: Column | str, token_type: Column | str) -> Column:
    """I23."""
    return F.coalesce(blank_to_null(symbol), F.when(F.upper(col(token_type)) == "NATIVE", "SOL").otherwise("UNKNOWN"))


def token_name(name: Column | str, token_type: Column | str) -> Column:
    """I23."""
    return F.coalesce(blank_to_null(name), F.when(F.upper(col(token_type)) == "NATIVE", "Solana").otherwise("Unknown Token"))


def string_map(json: Column | str) -> Column:
    """JSON as a map of strings; unreadable JSON is an empty one."""
    return F.coalesce(F.from_json(col(json), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def overlaid(base: Column, over: Column) -> Column:
    """`base` with the entries of `over` in place of its own."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def is_staking(activity_type: Column | str) -> Column:
    """I6."""
    return col(activity_type).isin(*STAKING)


def unix_time(c: Column | str) -> Column:
    """Seconds to a timestamp; 0 is no time."""
    return F.timestamp_seconds(F.nullif(col(c), F.lit(0)))
