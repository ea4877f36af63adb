"""Near copies by likeness, the general form of `simhash`: Golay-code fuzzy hashing of longer fingerprints, for documents whose sets of
five-word shingles have a Jaccard similarity of at least 0.8.

The signs of sums that make a SimHash of 64 bits differ in 15 % of their places at that similarity, too many for any code. So a
fingerprint here has 460 bits, each the one-bit hash of a min-wise hash, of which only (1 - similarity) / 2 differ: 10 %. It is cut
into 20 segments of 23 bits. Each segment is decoded to the indices of the Golay codewords nearby, and a key joins such an index with
two whole min-wise hashes of the segment's own. Two sets of similarity 0.8 share a codeword in 0.80 of the segments and a key in 0.51 of
them, so they share no key at all with a chance of 5e-7; more alike ones far less. Of the sets that share a key, those whose
fingerprints differ in at most 77 bits (a set of similarity 0.8 is over with a chance of 1e-6) are joined by a spanning forest, and the
components of these forests are families. Every two sets that are alike are thus of one family.

Within a family the shingles themselves decide: each family meets in one task, which counts what its sets share through an inverted
index and follows exact links only. Families of more than `FAMILY` shingles are dealt into blocks, and every two blocks meet
in a task of their own; keys of more than `BUCKET` sets likewise. No pair is ever written but links of a forest.

Defined results: null, empty and blank texts have no shingles and are alike; a text of fewer than five words is one shingle; words and case
are as in `simhash`; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import arrow_rows, dropped, few, fresh, in_arrow, shipped, written
from ledgerloom.llm.components import connected
from ledgerloom.llm.golay import N as SEGMENT
from ledgerloom.llm.golay import nearby

WORDS = 5
#: The least likeness that links, as a fraction.
LIKE, OF = 4, 5
#: Segments of a fingerprint, whole min-wise hashes in a key, and differing bits up to which shingles are counted.
TABLES, WHOLE, RADIUS = 20, 2, 77
SEED = 42
#: Shingles hashed at a time.
STEP = 4096
#: Sets of one key that a task holds at a time, and shingles of one family.
BUCKET, FAMILY = 50_000, 2_000_000
#: 64-bit words of a fingerprint.
LANES = -(-TABLES * SEGMENT // 64)

_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 2**63, TABLES * (SEGMENT + WHOLE), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**64, TABLES * (SEGMENT + WHOLE), np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a text's distinct word shingles, in order."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(lengths) + np.arange(len(words))
    starts = (ends - lengths).tolist()
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist() or [len(joined)])], np.uint64))


def name_of(found: np.ndarray) -> int:
    """The id of a set of shingles, signed."""
    return int.from_bytes(blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a set of shingles that isn't empty: the fingerprint's words, and a hash of the whole min-wise hashes of each segment."""
    least = np.full(len(_TIMES), 2**64 - 1, np.uint64)
    for s in range(0, len(found), STEP):
        np.minimum(least, (found[s : s + STEP, None] * _TIMES + _PLUS).min(0), out=least)
    bits = np.zeros(64 * LANES, np.uint8)
    bits[: TABLES * SEGMENT] = _mixed(least[: TABLES * SEGMENT]) >> np.uint64(63)
    whole = np.zeros(TABLES, np.uint64)
    for x in least[TABLES * SEGMENT :].reshape(WHOLE, TABLES):
        whole = _mixed(whole ^ x)
    return np.packbits(bits, bitorder="little").view("<u8"), whole


def keys_of(fingerprints: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for all keys of fingerprints (rows by LANES) and their hashes (rows by TABLES)."""
    bits = np.unpackbits(np.ascontiguousarray(fingerprints).view(np.uint8), axis=1, bitorder="little")
    segments = bits[:, : TABLES * SEGMENT].reshape(len(bits), TABLES, SEGMENT).astype(np.int64) @ (1 << np.arange(SEGMENT))
    keys, rows = [], []
    for k in range(TABLES):
        index, counts = nearby(segments[:, k])
        row, column = np.nonzero(counts)
        keys.append(_mixed(whole[row, k] ^ _mixed((index[row, column] * TABLES + k + 1).astype(np.uint64))))
        rows.append(row)
    return np.concatenate(keys).view(np.int64), np.concatenate(rows)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles are as alike as LIKE / OF; two empty ones are."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= LIKE * (len(a) + len(b) - both)


Links = tuple[list[int], list[int]]


def searched(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Links:
    """A spanning forest of n nodes by breadth-first search: near(i, others) tells which of the others are linked to i."""
    a: list[int] = []
    b: list[int] = []
    left = np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(at, left)
            if hit.any():
                found = left[hit].tolist()
                left = left[~hit]
                queue += found
                a += [at] * len(found)
                b += found
    return a, b


def close(fingerprints: np.ndarray) -> Links:
    """The forest of sets of one key whose fingerprints differ in at most RADIUS bits."""
    return searched(len(fingerprints), lambda i, others: np.bitwise_count(fingerprints[others] ^ fingerprints[i]).sum(1) <= RADIUS)


def linked(sets: list[np.ndarray]) -> Links:
    """The forest of the sets that are alike, by the counts of their shingles."""
    if len(sets) == 2:
        return ([0], [1]) if alike(*sets) else ([], [])
    sizes = np.array([len(s) for s in sets])
    names, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(len(sets)), sizes)[order]
    first = np.searchsorted(token[order], np.arange(len(names) + 1))
    rows = np.concatenate([[0], np.cumsum(sizes)])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        own = token[rows[i] : rows[i + 1]]
        n = first[own + 1] - first[own]
        both = np.bincount(holder[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        return OF * both[others] >= LIKE * (sizes[i] + sizes[others] - both[others])

    return searched(len(sets), near)


def text_hash() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, set_id, size, bits, whole) for every row; of an empty set the last two are null."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [shingles(t) for t in batch.column(2).to_pylist()]
        both = [sketch(s) if len(s) else (None, None) for s in found]
        raw = lambda k: pa.array([None if x[k] is None else x[k].tobytes() for x in both], pa.binary())
        return {"doc_id": batch.column(0), "text_hash": batch.column(1), "set_id": pa.array(map(name_of, found), pa.int64()), "size": pa.array(map(len, found), pa.int64()), "bits": raw(0), "whole": raw(1)}

    return in_arrow(docs.select("doc_id", text_hash().alias("text_hash"), "text"), run, "doc_id long, text_hash long, set_id long, size long, bits binary, whole binary")


def stacked(column: pa.Array, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, lanes)


def shared_keys(one: DataFrame) -> DataFrame:
    """(key, set_id) for the keys that two or more sets have."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 1024):
                part = batch.slice(s, 1024)
                key, row = keys_of(stacked(part.column(1), LANES), stacked(part.column(2), TABLES))
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(pa.array(row))], names=["key", "set_id"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, bool] | None = None  # the last row, and whether the one before has its key
        for batch in batches:
            if not len(batch):
                continue
            key, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            before = False
            if held:
                key, ids, before = np.concatenate([[held[0]], key]), np.concatenate([[held[1]], ids]), held[2]
            same = key[1:] == key[:-1]
            keep = np.concatenate([[before], same])
            keep[:-1] |= same
            held = (int(key[-1]), int(ids[-1]), bool(keep[-1]))
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(ids[keep])], names=["key", "set_id"])
        if held and held[2]:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held[:2]], names=["key", "set_id"])

    keyed = one.where("bits is not null").select("set_id", "bits", "whole").mapInArrow(emit, "key long, set_id long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(several, "key long, set_id long")


def _by_group(rows: DataFrame, forest: Callable[[list], Links], read: Callable[[pa.Array], list]) -> DataFrame:
    """(a, b): the forest of each group's rows (group, id, data), of which a task holds one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, data, seen = None, [], [], set()

        def out() -> pa.RecordBatch:
            a, b = forest(data) if len(ids) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in x], pa.int64()) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            names, values = batch.column(1).to_pylist(), read(batch.column(2))
            starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else []
            for s, e in zip(starts, [*starts[1:], len(groups)]):
                if groups[s] != group:
                    if len(ids) > 1:
                        yield out()
                    group, ids, data, seen = groups[s], [], [], set()
                for k in range(s, e):
                    if names[k] not in seen:
                        seen.add(names[k])
                        ids.append(names[k])
                        data.append(values[k])
        if len(ids) > 1:
            yield out()

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")


def _in_blocks(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(group, id, data): rows (key, id, data) whose key's sum of `sizes` (key, n) is up to `most` in one group, those of larger keys
    in one for every two of their blocks."""
    large = written(sizes.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most), "large")
    plain = rows.select(F.col("key").alias("group"), "id", "data")
    if large.isEmpty():
        return plain
    blocks = large.select("key", F.ceil(F.col("n") / F.lit(max(1, most // 2))).alias("n"))
    dealt = rows.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "id", "data")
    return rows.join(large, "key", "left_anti").select(F.col("key").alias("group"), "id", "data").unionAll(pairs)


def components(docs: DataFrame, sets: DataFrame, bucket: int = BUCKET, family: int = FAMILY) -> DataFrame:
    """(node, root) for every set of `sets` (of `docs`) that is alike another."""
    spark = shipped(docs.sparkSession)
    row = F.min(F.struct("doc_id", "text_hash")).alias("row")
    one = written(sets.where("bits is not null").groupBy("set_id").agg(row, F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("whole").alias("whole")), "sets")
    with arrow_rows(spark, 1 << 14):  # some numbers a row
        shared = written(shared_keys(one), "shared")
        rows = shared.join(one.select("set_id", "bits"), "set_id").select("key", F.col("set_id").alias("id"), F.col("bits").alias("data"))
        close_ = lambda data: close(np.stack(data))
        trees = written(_by_group(_in_blocks(rows, shared.select("key", F.lit(1).alias("n")), bucket), close_, lambda c: list(stacked(c, LANES))), "trees")
    grown = connected(trees, "a", "b")
    families = written(grown.distinct().join(one.select("set_id", "row", "size"), F.col("node") == F.col("set_id")).select("set_id", F.col("root").alias("key"), "row.*", "size"), "families")
    wanted = families.select("set_id", "key", "size", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
    texts = docs.select("doc_id", text_hash().alias("text_hash"), "text").join(few(wanted), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows with an id and text that repeats are one set; a task passes it on once
        for batch in batches:
            rows = []
            for key, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if name not in seen and name_of(found := shingles(text)) == name:
                    seen.add(name)
                    rows.append((key, name, found.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["key", "id", "data"])

    members = texts.select("key", "set_id", "text").mapInArrow(run, "key long, id long, data binary")
    sizes = families.select("key", F.col("size").alias("n"))
    exact = written(_by_group(_in_blocks(members, sizes, family), linked, lambda c: [np.frombuffer(x, "<u8") for x in c.to_pylist()]), "links")
    groups = connected(exact, "a", "b")
    for done in (one, shared, trees, grown, families, exact):
        dropped(done)
    out = groups.distinct()
    out.written_path = groups.written_path
    return out


def representatives(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group of near copies: that with the smallest id, and of those the smallest text hash.

    Rows are known by id and text, so an id that repeats with other texts keeps a row in each group that it leads. Rows without an id
    stay: no id names them.
    """
    sets = written(sets_of(docs), "shingled")
    groups = components(docs, sets)
    named = sets.where("doc_id is not null")
    least = named.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    of_group = least.join(groups, least.set_id == groups.node, "left").groupBy(F.coalesce("root", "set_id").alias("root")).agg(F.min("row").alias("row"))
    kept = of_group.select(F.col("row.doc_id").alias("_id"), F.col("row.text_hash").alias("_hash")).distinct()
    times = named.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg((F.count("*") > 1).alias("_again"))
    kept = written(kept.join(times, ["_id", "_hash"]), "kept")
    dropped(sets)
    dropped(groups)
    id_, hash_, place, kept_id, kept_hash = fresh(docs, "id", "hash", "place", "kept_id", "kept_hash")
    kept = kept.withColumnsRenamed({"_id": kept_id, "_hash": kept_hash})
    own = lambda df, right: df.join(right, (F.col(id_) == F.col(kept_id)) & (F.col(hash_) == F.col(kept_hash)), "left_semi")
    rows = docs.where("doc_id is not null").withColumns({id_: F.col("doc_id"), hash_: text_hash()})
    out = own(rows, few(kept.where("not _again"))).select(*docs.columns)
    again = kept.where("_again")
    if not again.isEmpty():  # one of each text that repeats under its id
        first = Window.partitionBy(id_, hash_).orderBy(F.col("text").asc_nulls_first(), *[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")])
        out = out.unionAll(own(rows, few(again)).withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*docs.columns))
    return out.unionAll(docs.where("doc_id is null"))
