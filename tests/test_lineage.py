"""Policy lineage against cases worked out by hand."""

import pytest

from ledgerloom.operators import lineage
from ledgerloom.operators.lineage import CHAIN, FIELDS, MARKERS

FENCE = "rollback-from-seq=20|rollback-to-seq=10|rollback-forward-seq=30"
FREED = FENCE + "|rollback-fence-tombstone-expiry-epoch=11|rollback-fence-late-marker-hold-epoch=12|rollback-fence-late-marker-release-epoch=13"
SIDES = "prev_version string, prev_digest string, prev_epoch long, prev_hold int, warm boolean, version string, digest string, epoch long, hold int, _c7_tokens string, `a b` int"


def chain(markers: int, last: int = 0) -> str:
    """A released digest with all fields and so many markers, of which the last is greater by `last`."""
    named = {"watermark": 14, "bridge": 1, "drain": 15, "live": 16, "steady": 17, "generation": 9, "floor": 8}
    out = [FREED, *[f"{FIELDS[n][-1]}={named.get(n, 1)}" for n in ("watermark", *CHAIN)]]
    return "|".join(out + [f"{MARKERS[i][i % len(MARKERS[i])]}={i + (last if i == markers - 1 else 0)}" for i in range(markers)])


def decided(spark, cases):
    rows = [("v", a, 10, 4, False, "v", b, 10, 2, "kept", 1) for a, b in cases]
    return [(r.adopt, r.next_digest, r.next_epoch, r.next_hold) for r in lineage.transitions(spark.createDataFrame(rows, SIDES).coalesce(1)).collect()]


def test_names():
    assert len(MARKERS) == 22 and len({k for keys in [*FIELDS.values(), *MARKERS] for k in keys}) == sum(map(len, [*FIELDS.values(), *MARKERS]))
    assert MARKERS[12][4] == "rollback-fence-post-reintegration-seal-drift-reanchor-compaction-expiry-quarantine-reintegration-epoch"
    assert MARKERS[21][0].endswith("-reintegration-seal-drift-epoch") and MARKERS[21][0].count("seal") == 3


@pytest.mark.parametrize("digest, parts", [
    ("x| Rollback-From-Seq=5| rollback-to-seq= 3|rollback-forward-seq=+9", ("rollback", 5, 3, 9)), ("rollback-from-seq=5|rollback-to-seq=-3|rollback-forward-seq=9", None),
    ("rollback-from-seq=5|rollback-from-seq=6|rollback-to-seq=3|rollback-forward-seq=9", ("rollback", 6, 3, 9)), ("snapshot-base-seq=1|snapshot-tail-seq=9223372036854775808", None), ("snapshot-base-seq=1|snapshot-tail-seq=2", ("snapshot", 1, 2, None)), (None, None), ("", None),
])
def test_digests(spark, digest, parts):
    got = spark.createDataFrame([(digest,)], "d string").select(lineage.digest_parts(lineage.F.col("d")).alias("x")).first().x
    assert (got if got is None else tuple(got)) == parts


def test_stages_and_orders(spark):
    a, b = chain(13), chain(14)
    later = chain(14, last=5)
    assert decided(spark, [(a, b), (b, a), (b, later), (later, b), (b, b), (chain(5), chain(6)), (a, chain(14) + f"|{MARKERS[13][0]}=99")]) == [
        (True, b, 10, 0), (False, b, 10, 0), (True, later, 10, 0), (False, later, 10, 0), (False, b, 10, 4), (True, chain(6), 10, 0), (False, a, 10, 4),
    ]


def test_orders_need_their_chain(spark):
    gap = chain(14).replace(MARKERS[7][7 % len(MARKERS[7])], "other")
    flat = chain(6).replace(f"{MARKERS[5][5 % 4]}=5", f"{MARKERS[5][5 % 4]}=4")
    digests = [chain(0), chain(14), gap, flat, chain(3).replace(f"{FIELDS['floor'][-1]}=8", f"{FIELDS['floor'][-1]}=10"), FREED, FENCE, None]
    rows = lineage.ownership(spark.createDataFrame([(d, 10, 1) for d in digests], "digest string, epoch long, _c7_order int").coalesce(1)).collect()
    assert rows[0].slots == [10, 1, 15, 16, 17, 9, 8, 1, 1, 1, 1, 1] + [0] * 22
    assert rows[1].slots == rows[0].slots[:12] + [*range(14)] + [0] * 8
    assert rows[5].slots == [10, 0, 13, 13, 13] + [0] * 29
    assert [r.slots for r in (*rows[2:5], *rows[6:])] == [None] * 5 and all(r._c7_order == 1 for r in rows)


def test_defaults_and_other_columns(spark):
    rows = [(None, None, None, None, None, "POLICY-V1 ", "manifest-v1", 1, None, "kept", 7), ("v", "d", -5, -1, True, "w", "e", None, 3, None, None)]
    out = lineage.transitions(spark.createDataFrame(rows, SIDES).coalesce(1))
    assert out.columns[:11] == [c.split(" ")[0].strip("`") if c != "`a b` int" else "a b" for c in SIDES.split(", ")]
    first, second = out.collect()
    assert (first.adopt, first.next_digest, first.next_epoch, first.next_hold, first["_c7_tokens"], first["a b"]) == (True, "manifest-v1", 1, 0, "kept", 7)
    assert (second.adopt, second.next_digest, second.next_epoch, second.next_hold) == (True, "e", 1, 3)
    assert lineage.transitions(spark.createDataFrame([], SIDES)).count() == 0
