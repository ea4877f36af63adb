"""Policy lineage (C7): which of two policy states holds after a transition, told from the digests of their manifests.

A digest is a list of `key=value` tokens between bars. `transitions` reads both sides' tokens into plain columns, one projection after
another so that nothing is parsed twice, and decides by one conditional; every row stands for itself, so there is no shuffle.

Defined results: null and empty versions and digests are the default ones, negative and null epochs and holds are 0; a value that is not
a whole number from 0 to 2^63 - 1 counts as missing, except that it voids an ownership order; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults, token keys with their other names, in the order of the ownership slots.
VERSION, DIGEST = "policy-v1", "manifest-v1"
FROM, TO, FORWARD = "rollback-from-seq", "rollback-to-seq", "rollback-forward-seq"
BASE, TAIL = "snapshot-base-seq", "snapshot-tail-seq"
TOMBSTONE, SET_WORDS = "rollback-fence-tombstone", ("1", "true", "yes", "on")
EXPIRY, HOLD = "rollback-fence-tombstone-expiry-epoch", "rollback-fence-late-marker-hold-epoch"
FIELDS = {
    "release": ("rollback-fence-late-marker-release-epoch",),
    "bridge": ("rollback-fence-late-bridge-sequence", "rollback-fence-late-bridge-seq"),
    "watermark": ("rollback-fence-late-bridge-release-watermark", "rollback-fence-release-watermark"),
    "drain": ("rollback-fence-late-bridge-drain-watermark", "rollback-fence-backlog-drain-watermark", "rollback-fence-drain-watermark"),
    "live": ("rollback-fence-live-head", "rollback-fence-live-catchup-head", "rollback-fence-live-watermark"),
    "steady": ("rollback-fence-steady-state-watermark", "rollback-fence-steady-watermark", "rollback-fence-rebaseline-watermark"),
    "generation": ("rollback-fence-steady-generation", "rollback-fence-baseline-generation"),
    "floor": ("rollback-fence-generation-retention-floor", "rollback-fence-retention-floor"),
    "lift": ("rollback-fence-floor-lift-epoch", "rollback-fence-retention-floor-lift-epoch"),
    "settle": ("rollback-fence-settle-window-epoch", "rollback-fence-floor-lift-settle-window-epoch"),
    "spillover": ("rollback-fence-spillover-epoch", "rollback-fence-late-spillover-epoch", "rollback-fence-settle-window-spillover-epoch"),
    "rejoin": ("rollback-fence-spillover-rejoin-epoch", "rollback-fence-rejoin-window-epoch", "rollback-fence-late-spillover-rejoin-epoch"),
    "seal": ("rollback-fence-rejoin-seal-epoch", "rollback-fence-steady-seal-epoch", "rollback-fence-post-rejoin-seal-epoch"),
}
FIRST_MARKERS = (
    ("rollback-fence-seal-drift-epoch", "rollback-fence-steady-seal-drift-epoch", "rollback-fence-post-steady-seal-drift-epoch"),
    ("rollback-fence-drift-reanchor-epoch", "rollback-fence-post-drift-reanchor-epoch", "rollback-fence-post-steady-drift-reanchor-epoch"),
    ("rollback-fence-reanchor-compaction-epoch", "rollback-fence-post-reanchor-compaction-epoch", "rollback-fence-post-drift-reanchor-compaction-epoch"),
    ("rollback-fence-compaction-expiry-epoch", "rollback-fence-lineage-compaction-expiry-epoch", "rollback-fence-post-lineage-compaction-expiry-epoch"),
    (
        "rollback-fence-resurrection-quarantine-epoch", "rollback-fence-late-resurrection-quarantine-epoch", "rollback-fence-post-expiry-late-resurrection-quarantine-epoch",
        "rollback-fence-post-marker-expiry-late-resurrection-quarantine-epoch",
    ),
    (
        "rollback-fence-resurrection-reintegration-epoch", "rollback-fence-late-resurrection-reintegration-epoch", "rollback-fence-post-late-resurrection-quarantine-reintegration-epoch",
        "rollback-fence-post-marker-expiry-late-resurrection-reintegration-epoch",
    ),
)
#: The markers after these go round one cycle of steps; each names all steps up to its own.
CYCLE, LATER = ("seal", "drift", "reanchor", "compaction", "expiry", "quarantine", "reintegration"), 16
STEMS = ("resurrection-reintegration", "late-resurrection-reintegration", "post-late-resurrection-reintegration", "post-marker-expiry-late-resurrection-reintegration", "post-reintegration")
#: Markers by which one side is a stage ahead, in the order in which they are asked.
STAGES = (13, 14, 15, 16, 18, 12, 19, 20, 21)
SPACE = " \t\n\v\f\r\x85\xa0"


def _later(n: int) -> tuple[str, ...]:
    steps = "-".join(CYCLE[k % len(CYCLE)] for k in range(n))
    return tuple(f"rollback-fence-{stem}-{steps}-epoch" for stem in STEMS)


MARKERS = (*FIRST_MARKERS, *(_later(n) for n in range(1, LATER + 1)))
#: Fields of which each needs the one before it, and the first marker the last of them.
CHAIN = ("bridge", "drain", "live", "steady", "generation", "floor", "lift", "settle", "spillover", "rejoin", "seal")
#: The number of each key's slot: the fields in order, then the markers.
_SLOTS = {key: i for i, keys in enumerate([*FIELDS.values(), *MARKERS]) for key in keys}
_AT = {name: i for i, name in enumerate(FIELDS)}


def normalised(text: Column, default: str) -> Column:
    plain = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACE))
    return F.when(plain == "", default).otherwise(plain)


def number(text: Column) -> Column:
    """The whole number from 0 that a text spells, or null."""
    return F.when(text.rlike(r"\A(?:[+]?[0-9]+|-0+)\z"), text.try_cast("long"))


def tokens(digest: Column) -> Column:
    """array<struct<key, value, slot>> of a normalised digest; the value is null where there is no sign of equality."""
    slots = F.expr("map(" + ", ".join(f"'{key}', {i}" for key, i in _SLOTS.items()) + ")")

    def token(t: Column) -> Column:
        plain = F.btrim(t, F.lit(SPACE))
        key, at = F.substring_index(plain, "=", 1), F.instr(plain, "=")
        return F.struct(key.alias("key"), F.when(at > 0, F.btrim(F.substr(plain, at + 1), F.lit(SPACE))).alias("value"), F.try_element_at(slots, key).alias("slot"))

    return F.transform(F.split(digest, r"\|"), token)


def _values(tokens: Column, by: str, name: str | Column) -> Column:
    return F.transform(F.filter(tokens, lambda t: (t[by] == name) & t["value"].isNotNull()), lambda t: t["value"])


def last(tokens: Column, key: str) -> Column:
    found = _values(tokens, "key", key)
    return number(F.get(found, F.size(found) - 1))


def first(tokens: Column, key: str) -> Column:
    return number(F.get(_values(tokens, "key", key), 0))


def is_set(tokens: Column) -> Column:
    """Whether a digest has the tombstone of a compaction."""
    return F.exists(tokens, lambda t: (t["key"] == TOMBSTONE) & (t["value"].isNull() | t["value"].isin(*SET_WORDS)))


def fields(tokens: Column) -> Column:
    """The first value of each field under any of its names; -1 if that one is not a number, null without any."""

    def one(i: Column) -> Column:
        found = _values(tokens, "slot", i)
        return F.when(F.size(found) > 0, F.coalesce(number(F.get(found, 0)), F.lit(-1)))

    return F.transform(F.sequence(F.lit(0), F.lit(len(FIELDS) - 1)), one)


def markers(tokens: Column) -> Column:
    """C7e: the value on which all tokens of each marker agree; null without one, or where they differ or one is not a number."""

    def one(i: Column) -> Column:
        found = F.array_distinct(F.transform(F.filter(_values(tokens, "slot", i), lambda v: v != ""), number))
        return F.when(F.size(found) == 1, F.get(found, 0))

    return F.transform(F.sequence(F.lit(len(FIELDS)), F.lit(len(FIELDS) + len(MARKERS) - 1)), one)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def digest_parts(text: Column) -> Column:
    """struct(kind, first, second, third) of a digest: rollback (from, to, forward) or snapshot (base, tail); null for others."""
    t = tokens(normalised(text, DIGEST))
    shape = lambda kind, *x: F.struct(F.lit(kind).alias("kind"), *[c.alias(n) for c, n in zip(x, ("first", "second", "third"))])
    a, b, c, base, tail = (last(t, k) for k in (FROM, TO, FORWARD, BASE, TAIL))
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), shape("rollback", a, b, c)).when(base.isNotNull() & tail.isNotNull(), shape("snapshot", base, tail, F.lit(None).cast("long")))


def _read(df: DataFrame, p: str, digest: Column, epoch: Column) -> DataFrame:
    """`df` with what a digest says under the prefix `p`; kinds and the order are those at `epoch`."""
    c = lambda name: F.col(f"`{p}{name}`")
    put = lambda df, columns: df.withColumns({p + n: x for n, x in columns.items()})
    df = put(df, {"tokens": tokens(digest)})
    t = c("tokens")
    df = put(df, {
        **{n: last(t, k) for n, k in (("from", FROM), ("to", TO), ("forward", FORWARD), ("base", BASE), ("tail", TAIL))}, "tomb": is_set(t), "expiry": first(t, EXPIRY), "hold": first(t, HOLD),
        "freed": first(t, FIELDS["release"][0]), "fields": fields(t), "markers": markers(t),
    })
    yes = lambda x: F.coalesce(x, F.lit(False))
    anchored = yes((c("to") == epoch) & (c("from") > c("to")) & (c("forward") >= c("from")))
    expired = ~c("tomb") & anchored & yes(c("expiry") > epoch)
    held = expired & yes(c("hold") > c("expiry"))
    df = put(df, {
        "anchored": anchored, "compaction": c("tomb") & anchored, "expired": expired & c("hold").isNull() & c("freed").isNull(), "quarantined": held & c("freed").isNull(), "released": held & yes(c("freed") > c("hold")),
        "chain": F.concat(F.array(*[F.get(c("fields"), _AT[n]) for n in CHAIN]), c("markers")),
    })
    # the watermarks that are missing take the value of the one before
    at = lambda n: F.get(c("fields"), _AT[n])
    put_off = {"w": F.coalesce(at("watermark"), at("release"))}
    for n, before in (("drain", "w"), ("live", "drain"), ("steady", "live")):
        put_off[n] = F.coalesce(at(n), put_off[before])
    df = put(df, put_off)
    here, step = (lambda i: F.get(c("chain"), i)), (lambda i: F.get(c("chain"), i - 1))
    chained = ~F.exists(F.sequence(F.lit(1), F.lit(len(CHAIN) + len(MARKERS) - 1)), lambda i: here(i).isNotNull() & step(i).isNull())
    rising = ~F.exists(F.sequence(F.lit(len(CHAIN) + 4), F.lit(len(CHAIN) + len(MARKERS) - 1)), lambda i: yes(here(i) <= step(i)))
    zero = lambda n: F.coalesce(at(n), F.lit(0).cast("long"))
    valid = _all([
        c("released"), at("release").isNotNull(), F.forall(c("fields"), lambda x: x.isNull() | (x >= 0)), at("bridge").isNull() == at("watermark").isNull(), chained, rising,
        c("w") >= at("release"), c("drain") >= c("w"), c("live") >= c("drain"), c("steady") >= c("live"), zero("floor") <= zero("generation"),
    ])
    rest = F.transform(F.slice(c("chain"), CHAIN.index("generation") + 1, len(CHAIN) + len(MARKERS)), lambda x: F.coalesce(x, F.lit(0).cast("long")))
    return put(df, {"order": F.when(yes(valid), F.concat(F.array(epoch.cast("long"), zero("bridge"), c("drain"), c("live"), c("steady")), rest))})


def _ahead(s, t) -> Column:
    """C7c's last rule, between two released sides: the target is a stage further, or no stage apart and later in the ownership order."""
    there = lambda side, i: F.get(side("markers"), i).isNotNull()
    apart = F.filter(F.array(*map(F.lit, STAGES)), lambda i: there(s, i) != there(t, i))
    return s("order").isNotNull() & t("order").isNotNull() & F.when(F.size(apart) > 0, there(t, F.get(apart, 0))).otherwise(s("order") < t("order"))


def _succeeds(s, t) -> Column:
    """Whether a digest follows another at one epoch, by any of the five rules."""
    same = lambda *names: _all([s(n) == t(n) for n in names])
    pair = s("anchored") & t("anchored") & same("from", "to", "forward")
    rules = [
        t("tomb"), s("compaction") & t("expired"), s("expired") & t("quarantined") & same("expiry"), s("quarantined") & t("released") & same("expiry", "hold"),
        s("released") & t("released") & same("expiry", "hold") & _ahead(s, t),
    ]
    return F.coalesce(pair & reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(False)) for r in rules]), F.lit(False))


def _prefix(df: DataFrame) -> str:
    prefix = "_c7_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def ownership(df: DataFrame, digest: str = "digest", epoch: str = "epoch", out: str = "slots") -> DataFrame:
    """C7f: `df` with the 34 slots of each digest's ownership order as an array that compares slot by slot; null where it has none."""
    p = _prefix(df)
    read = _read(df, p, normalised(F.col(digest), DIGEST), F.when(F.col(epoch) >= 0, F.col(epoch)))
    return read.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"{p}order").alias(out))


def transitions(df: DataFrame) -> DataFrame:
    """C7b-C7d over (prev_version, prev_digest, prev_epoch, prev_hold, warm; version, digest, epoch, hold): `df` with `adopt`,
    `next_digest`, `next_epoch` and `next_hold`.

    The incoming side's hold starts anew where it is adopted as a step; elsewhere what is left of the previous side's stays, which a
    warm restart cuts to none after a compaction and to one tick after a rollback; a same-epoch rule starts none.
    """
    p = _prefix(df)
    c = lambda name: F.col(p + name)
    whole = lambda name: F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(0)).cast("long")
    own = {
        "v0": normalised(F.col("prev_version"), VERSION), "v1": normalised(F.col("version"), VERSION), "d0": normalised(F.col("prev_digest"), DIGEST), "d1": normalised(F.col("digest"), DIGEST),
        "e0": whole("prev_epoch"), "e1": whole("epoch"), "h0": whole("prev_hold"), "h1": whole("hold"),
    }
    at = df.withColumns({p + k: x for k, x in own.items()})
    at = _read(_read(at, f"{p}s_", c("d0"), c("e0")), f"{p}t_", c("d1"), c("e0"))
    s, t = (lambda side: lambda name: F.col(f"{p}{side}_{name}"))("s"), (lambda side: lambda name: F.col(f"{p}{side}_{name}"))("t")
    yes = lambda x: F.coalesce(x, F.lit(False))
    fence = yes((s("to") == c("e0")) & (s("from") > s("to")) & s("forward").isNotNull())
    left = F.when(F.coalesce("warm", F.lit(False)) & s("compaction"), 0).when(F.coalesce("warm", F.lit(False)) & fence, F.least(c("h0"), F.lit(1))).otherwise(c("h0"))
    at = at.withColumns({f"{p}left": left.cast("long"), f"{p}on": _succeeds(s, t), f"{p}off": _succeeds(t, s)})
    step = c("e1") == c("e0") + 1
    cutover = yes((c("e1") > c("e0") + 1) & (t("base") == c("e0")) & (t("tail") == c("e1")))
    back = yes((t("from") == c("e0")) & (t("to") == c("e1")) & (t("forward") >= t("from")))
    says = lambda adopt, epoch, hold: F.struct(F.lit(adopt).alias("adopt"), epoch.alias("epoch"), hold.cast("long").alias("hold"))
    pin, take = says(False, c("e0"), c("left")), says(True, c("e1"), c("h1"))
    none = F.lit(0)
    at = at.withColumn(
        f"{p}told",
        F.when((c("v0") == c("v1")) & (c("d0") == c("d1")), F.when(step, says(True, c("e1"), F.greatest(c("h1"), c("left")))).otherwise(pin))
        .when(c("v0") != c("v1"), says(True, F.greatest(c("e0") + 1, c("e1")), c("h1")))
        .when(c("e1") > c("e0"), F.when(step & s("released") & t("anchored"), pin).when(step | cutover, take).otherwise(pin))
        .when(c("e1") < c("e0"), F.when(back, take).otherwise(pin))
        .when(c("on"), says(True, c("e0"), none))
        .when(c("off"), says(False, c("e0"), none))
        .otherwise(pin),
    )
    told = c("told")
    return at.select(*[F.col(f"`{x}`") for x in df.columns], told["adopt"].alias("adopt"), F.when(told["adopt"], c("d1")).otherwise(c("d0")).alias("next_digest"), told["epoch"].alias("next_epoch"), told["hold"].alias("next_hold"))
