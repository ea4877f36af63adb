"""Scalar rules by tables, big integers against Python's."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import bignum
from ledgerloom.functions import scalar as S


def evaluate(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "chain,given,want",
    [
        ("base", " 0xABc ", "0xabc"), ("base", "ABC", "0xabc"), ("base", "0x", ""), ("base", "0X", ""), ("base", "xyz", "xyz"), ("base", "", ""), ("base", "0xZZ", "0xzz"),
        ("btc", "0xABC", "abc"), ("btc", "0x0XAB", "ab"), ("btc", "AB", "ab"), ("solana", " AbC\t", "AbC"),
    ],
)
def test_signature_identity(spark, chain, given, want):
    assert evaluate(spark, S.signature_identity("c", "v"), c=chain, v=given) == want


@pytest.mark.parametrize("chain,given,want", [("base", "0x", "0x"), ("base", " 0XAB", "0xab"), ("base", "ab", "0xab"), ("btc", " AB ", "AB"), ("base", "", "")])
def test_address_identity(spark, chain, given, want):
    assert evaluate(spark, S.address_identity("c", "v"), c=chain, v=given) == want


@pytest.mark.parametrize(
    "kind,delta,want",
    [("TRANSFER", "5", "DEPOSIT"), ("TRANSFER", "-5", "WITHDRAWAL"), ("TRANSFER", "0", "WITHDRAWAL"), ("TRANSFER", "x", "WITHDRAWAL"), ("STAKE", "1", "UNSTAKE"), ("STAKE", "-1", "STAKE"), ("REWARD", "1", "CLAIM_REWARD"), ("fee_data_l1", "-1", "FEE_DATA_L1"), ("fee", "1", "OTHER")],
)
def test_activity(spark, kind, delta, want):
    assert evaluate(spark, S.activity("k", "d"), k=kind, d=delta) == want


@pytest.mark.parametrize("given,want", [("12", "-12"), ("-12", "-12"), ("+007", "-007"), ("", "-0"), ("0", "-0"), ("00", "-0"), ("1.5", "-0"), (" 3 ", "-3"), (None, "-0")])
def test_fee_delta(spark, given, want):
    assert evaluate(spark, S.fee_delta("v"), v=given) == want


@pytest.mark.parametrize("given,norm,applied,stored", [("pending", 1, 1, 1), ("", 0, 4, 0), ("processed", 1, 1, 0), ("Finalised", 4, 4, 0), ("accepted", 2, 2, 0), ("safe", 3, 3, 3), ("odd", 0, 0, 0)])
def test_three_ranks(spark, given, norm, applied, stored):
    got = spark.range(1).select(F.lit(given).alias("s")).select(S.rank_norm("s").alias("a"), S.rank_ingest("s").alias("b"), S.rank_store("s").alias("c")).first()
    assert tuple(got) == (norm, applied, stored)


@pytest.mark.parametrize("given,want", [("outer:3|inner:-1", (3, -1)), (" Outer = 2 | INNER=0 ", (2, 0)), ("outer:3", None), ("outer:a|inner:1", None)])
def test_paths(spark, given, want):
    got = evaluate(spark, S.path_indices("v"), v=given)
    assert (tuple(got) if got else None) == want


def test_negation_is_its_own_inverse(spark):
    values = [str(random.Random(1).randint(-(10**70), 10**70)) for _ in range(50)] + ["0", "-0", "007"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(S.negated("v").alias("a"), S.negated(S.negated("v")).alias("b")).collect()
    assert [r.a for r in got] == [str(-int(v)) for v in values]
    assert [r.b for r in got] == [str(int(v)) for v in values]


def test_big_sums(spark):
    rng = random.Random(7)
    rows = [(rng.randint(0, 20), str(rng.randint(-(10 ** rng.randint(1, 76)), 10 ** rng.randint(1, 76)))) for _ in range(2000)]
    want = {}
    for k, v in rows:
        want[k] = want.get(k, 0) + int(v)
    got = bignum.big_sum(spark.createDataFrame(rows, "k int, v string"), ["k"], "v").collect()
    assert {r.k: int(r.total) for r in got} == want


def test_hex(spark):
    rng = random.Random(3)
    values = ["0x0", "0x", "", "zz", "12", "0xFF", hex(2**256 - 1), *[hex(rng.randrange(16 ** rng.randint(1, 64))) for _ in range(60)]]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(bignum.hex_to_string("v").alias("s"), F.when(F.length("v") <= 33, bignum.hex_to_decimal("v")).alias("d")).collect()
    for v, r in zip(values, got):
        want = int(v, 16) if v.startswith("0x") and len(v) > 2 else int(v) if v.isdigit() else 0
        assert int(r.s) == want, v
        assert r.d is None or int(r.d) == want, v
