"""SimHash near-duplicates: Golay-code fuzzy hashing finds all fingerprints within four bits.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Of at most four differing bits, the two least hit
segments have at most two, so one of these cases holds, and each makes a key of 31 to 34 bits that both fingerprints share:

* some segment is untouched and another has at most two errors: the first as it is, with an index of a Golay codeword
  near the second (6 ordered pairs of segments);
* two segments have one error each and the third at most two: the halves of the two without an error, with an index
  of a codeword near the third (12 choices of segment and halves).

Only distinct fingerprints get keys, so exact copies cost nothing. Rows of one key meet in sorted order; the true
links (checked by bit count) among them are reduced to a spanning forest, so a group of near copies yields no more links
than it has members. Keys with more than `bucket` fingerprints go through a second, exact pass: their rows are dealt
into blocks, and every two blocks meet in a task of their own. Components are found by distributed contraction.

Defined results: null, empty and blank texts have fingerprint zero and link as any other; a null id never
becomes a component's id unless all its ids are null; rows with equal ids are one document each; extra columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import arrow_rows, dropped, in_arrow, shipped, written
from ledgerloom.llm.components import connected
from ledgerloom.llm.golay import nearby

#: Differing bits that still link.
RADIUS = 4
SEED = 42
#: Distinct fingerprints of one key that a task holds at a time.
BUCKET = 50_000
#: Shingles hashed at a time.
STEP = 65_536
#: Offset and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, words_in_shingle: int = 4) -> int:
    """The SimHash of a text's word shingles, unsigned."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_in_shingle + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, STEP):
        part = words[start : min(n, start + STEP) + words_in_shingle - 1]
        joined = b" ".join(part)
        lengths = [len(w) for w in part]
        ends = np.cumsum(lengths) + np.arange(len(part))
        starts = (ends - lengths).tolist()
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words_in_shingle - 1 :].tolist() or [len(joined)])]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64), pa.int64())}

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for all keys of unsigned 64-bit fingerprints."""
    segments = [((fps >> np.uint64(o)) & np.uint64((1 << w) - 1)).astype(np.int64) for o, w in SEGMENTS]
    codes = [nearby(s) for s in segments]
    halves = [(s >> 11, s & 0x7FF) for s in segments]
    keys, rows, tag = [], [], 0

    def add(exact: np.ndarray, z: int) -> None:
        nonlocal tag
        index, counts = codes[z]
        row, col = np.nonzero(counts)
        keys.append((np.int64(tag) << 40) | (exact[row] << 12) | index[row, col])
        rows.append(row)
        tag += 1

    for x in range(3):
        for y in range(3):
            if x != y:
                add(segments[x], y)
    for z in range(3):
        x, y = (k for k in range(3) if k != z)
        for a in halves[x]:
            for b in halves[y]:
                add((a << 11) | b, z)
    return np.concatenate(keys), np.concatenate(rows)


def forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among distinct fingerprints, by breadth-first search over those not yet reached."""
    a, b, left = [], [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= RADIUS
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                a.extend([int(at)] * len(found))
                b.extend(found.tolist())
    return a, b


def links_of(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups of equal keys (sorted): all for groups of two and three, a spanning forest beyond."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    a, b = [], []
    for size, steps in ((2, ((0, 1),)), (3, ((0, 1), (0, 2), (1, 2)))):
        at = starts[sizes == size]
        for i, j in steps:
            a.append(fps[at + i])
            b.append(fps[at + j])
    more_a: list[int] = []
    more_b: list[int] = []
    for s, n in zip(starts[sizes > 3].tolist(), sizes[sizes > 3].tolist()):
        x, y = forest(np.unique(fps[s : s + n]))
        more_a += x
        more_b += y
    left, right = np.concatenate([*a, np.array(more_a, np.uint64)]), np.concatenate([*b, np.array(more_b, np.uint64)])
    true = (np.bitwise_count(left ^ right) <= RADIUS) & (left != right)
    return left[true], right[true]


def _linked(keyed: DataFrame, bucket: int | None) -> DataFrame:
    """(key, a, b): links between fingerprints of one key. Where a key has over `bucket` rows, they come out with key set and no b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        too_large: int | None = None

        def out(a: np.ndarray, b: np.ndarray | None, k: int | None = None) -> pa.RecordBatch:
            a = pa.array(a.view(np.int64), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([k] * len(a), pa.int64()), a, pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64), pa.int64())], names=["key", "a", "b"])

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(key):
                continue
            if too_large is not None:
                rest = int(np.searchsorted(key, too_large, "right"))
                yield out(fps[:rest], None, too_large)
                key, fps = key[rest:], fps[rest:]
                if not len(key):
                    held_key, held_fp = key, fps
                    continue
                too_large = None
            last = int(np.searchsorted(key, key[-1], "left"))
            if last:
                yield out(*links_of(key[:last], fps[:last]))
            held_key, held_fp = key[last:], fps[last:]
            if bucket and len(held_key) > bucket:
                too_large = int(held_key[0])
                yield out(held_fp, None, too_large)
                held_key, held_fp = held_key[:0], held_fp[:0]
        if len(held_key):
            yield out(*links_of(held_key, held_fp))

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, a long, b long")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between the distinct fingerprints of `distinct` (fp) whose components are those of all links."""
    shipped(distinct.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for s in range(0, len(every), 1024):
                fps = every[s : s + 1024]
                key, row = keys_of(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], names=["key", "fp"])

    with arrow_rows(distinct.sparkSession, 1 << 14):  # two numbers a row
        found = written(_linked(distinct.mapInArrow(emit, "key long, fp long"), bucket), "links")
    out = found.where("b is not null").select("a", "b")
    large = found.where("key is not null").select("key", F.col("a").alias("fp"))
    if large.limit(1).count():
        blocks = large.groupBy("key").agg(F.ceil(F.count("*") / F.lit(max(1, bucket // 2))).alias("n"))
        dealt = large.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        pairs = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
        out = out.unionAll(_linked(pairs, None).select("a", "b"))
    out.written_path = found.written_path
    return out


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp) for every row of `docs` (doc_id, text)."""
    fps = written(fingerprinted(docs), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    pairs = links(least.select("fp"), bucket)
    groups = connected(pairs, "a", "b")
    dropped(pairs)
    # tables of their own, so that joins deal both sides anew and a key with very many rows can be split among tasks
    joined = written(groups.join(least, groups.node == least.fp).select("node", "root", "least_id"), "members")
    names = written(joined.groupBy("root").agg(F.min("least_id").alias("group_id")), "names")
    of_group = joined.join(names, "root").select("node", "group_id")
    of_fp = least.join(of_group, least.fp == of_group.node, "left").select("fp", F.coalesce("group_id", "least_id").alias("component_id"))
    named = written(of_fp, "groups")
    for done in (groups, joined, names):
        dropped(done)
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
