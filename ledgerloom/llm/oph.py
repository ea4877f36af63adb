"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

All of it is DataFrame expressions. A text's five-word shingles are hashed once; the top bits of a hash name its bin, and
a bin keeps its least hash. An empty bin borrows the value of a filled one, chosen by hashing (bin, attempt) until a
filled one is met, the same choices for every text; what a few attempts leave empty takes the filled bin of the least
hash (bin, filled bin), which is the first of a random order of all bins and so ends the same series. Of each bin the low
eight bits are kept, two hexadecimal digits a bin. The share of equal bins of two fingerprints, less the share
that eight bits give by chance, estimates the Jaccard likeness of their shingles.

Likeness of a text to its edited form and to the next text needs each text's successor. Rows are dealt into ranges of
ids by counted quantiles, the texts move once, and a range's last row takes its successor from the first of the next
range by a small join.

Defined results: a null text is empty; a text of fewer than five words has its whole word sequence as its only shingle,
one without words has the shingle of no words; rows are ordered by descending id, ties by text, rows without an id last;
extra columns are not read; an empty table gives no rows; a single row is its own successor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_column

#: A power of two.
BINS = 256
SHINGLE = 5
#: Attempts at a filled bin before the rest of the random order is taken at once.
ATTEMPTS = 12
#: Rows in a range of ids.
RANGE_ROWS = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, words: int = SHINGLE) -> Column:
    """The sorted distinct hashes of the word shingles of a text, never empty."""

    def of(hashes: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(hashes) - words), lambda i: F.xxhash64(*[hashes[i + k] for k in range(words)]))
        return F.when(F.size(hashes) >= words, many).otherwise(F.array(F.xxhash64(hashes)))

    hashes = F.transform(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    return F.sort_array(let(hashes, of))


def bin_of(h: Column, bins: int) -> Column:
    """From 0, rising with the signed hash."""
    width = bins.bit_length() - 1
    return (F.shiftright(h, 64 - width) + bins // 2).cast("int")


def sketch(text: Column, bins: int = BINS) -> Column:
    """The densified low-order bits of a text, an array of `bins` integers below 256."""
    none = F.lit(None).cast("int")
    width = 64 - (bins.bit_length() - 1)

    def least(hashes: Column) -> Column:
        """The first hash of each filled bin, of sorted hashes."""
        return let(F.filter(hashes, lambda h, i: (i == 0) | (F.shiftrightunsigned(h.bitwiseXOR(F.get(hashes, i - 1)), width) != 0)), filled)

    def filled(first: Column) -> Column:
        def with_gap(h: Column, k: Column) -> Column:
            gap = bin_of(h, bins) - F.coalesce(bin_of(F.get(first, k - 1), bins), F.lit(-1)) - 1
            return F.concat(F.array_repeat(none, gap), F.array(h.bitwiseAND(255).cast("int")))

        rest = F.array_repeat(none, F.lit(bins - 1) - bin_of(F.element_at(first, -1), bins))
        return let(F.concat(F.flatten(F.transform(first, with_gap)), rest), lambda values: F.when(F.size(first) == bins, values).otherwise(borrowed(values, F.transform(first, lambda h: bin_of(h, bins)))))

    def borrowed(values: Column, names: Column) -> Column:
        def attempt(i: Column, t: int) -> Column:
            return F.get(values, F.xxhash64(i, F.lit(t)).bitwiseAND(bins - 1).cast("int"))

        def nearest(i: Column) -> Column:
            return F.get(values, F.array_min(F.transform(names, lambda j: F.xxhash64(i, j).bitwiseAND(-bins) + j)).bitwiseAND(bins - 1).cast("int"))

        return F.transform(values, lambda v, i: F.coalesce(v, *[attempt(i, t) for t in range(ATTEMPTS)], nearest(i)))

    return let(shingle_hashes(text), least)


def packed(values: Column) -> Column:
    """Two hexadecimal digits a bin."""
    return F.array_join(F.transform(values, lambda v: F.substring(F.hex(v + 256), 2, 2)), "")


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """The corrected share of equal bins, from 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(bins))
    chance = 1 / 256
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (equal - chance) / (1 - chance)))


def with_range(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """Adds `_range`: consecutive ids share a number, larger ids have smaller ones; the last holds rows without an id."""
    n = docs.count()
    ranges = max(1, min(20_000, -(-n // rows)))
    bounds = docs.select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("b")).first().b if ranges > 1 else None
    bounds = sorted(set(bounds or []))
    step = max(1, round(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    heads, table = F.lit([p[0] for p in parts[1:]] or [0]), F.array(*[F.lit(p or [0]) for p in parts])
    below = lambda xs, x: F.size(F.filter(xs, lambda b: b <= x))
    coarse = below(heads, F.col("doc_id")) if len(parts) > 1 else F.lit(0)
    place = let(coarse, lambda c: c * step + (below(table[c], F.col("doc_id")) if bounds else F.lit(0)))
    return docs.withColumn("_range", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.lit(len(bounds)) - place))


def compared(docs: DataFrame, bins: int = BINS, rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of the texts of `docs` (doc_id, text) and of their edited forms, and their likenesses."""
    ranged = with_range(docs.select("doc_id", text_column()), rows)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    # the first row of each range, taken by its id so that texts stay where they are
    tops = ranged.groupBy("_range").agg(F.max("doc_id").alias("top"))
    first = ranged.join(F.broadcast(tops), "_range").where("doc_id <=> top").groupBy("_range").agg(F.min("text").alias("text"))
    follows = first.select(F.col("_range").alias("of")).withColumn("_range", F.coalesce(F.lag("of").over(Window.partitionBy(F.lit(0)).orderBy("of")), F.lit(-1)))
    last = follows.agg(F.max("of").alias("last"))
    follows = follows.crossJoin(F.broadcast(last)).select("of", F.when(F.col("_range") == -1, F.col("last")).otherwise(F.col("_range")).alias("_range"))
    heads = first.join(follows, first["_range"] == follows["of"]).select(follows["_range"], first["text"].alias("head"))
    window = Window.partitionBy("_range").orderBy(*order)
    own = ranged.repartition("_range").withColumn("own", sketch(F.col("text"), bins))
    near = own.select("doc_id", "text", "own", "_range", F.lead(F.struct("text", "own")).over(window).alias("next"))
    inner = near.where("next is not null").select("doc_id", "text", "own", "next")
    tail = near.where("next is null").join(heads, "_range").select("doc_id", "text", "own", F.struct(F.col("head").alias("text"), sketch(F.col("head"), bins).alias("own")).alias("next"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows_ = inner.unionAll(tail).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next.own").alias("next_own"))
    rows_ = rows_.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own", sketch(F.col("edited"), bins).alias("edit"))
    return rows_.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("own")).alias("fingerprint"), packed(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit"), bins).alias("near_edited"), likeness(F.col("own"), F.col("next_own"), bins).alias("near_next"),
    )


def fingerprints(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """(doc_id, fingerprint) of every row of `docs` (doc_id, text)."""
    values = docs.select("doc_id", sketch(text_column(), bins).alias("own"))
    return values.select("doc_id", packed(F.col("own")).alias("fingerprint"))
