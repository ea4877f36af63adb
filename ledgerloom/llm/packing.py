"""Packing: vector bin packing by the dot-product heuristic.

Each example is a vector (tokens, one segment, loss-bearing tokens), each sequence a bin with a limit in every
dimension. An open sequence takes, of the examples that still fit, the one whose vector has the largest dot
product with what is free (both as shares of the limits), until none fits. With `cut`, one more example is then
cut so that its head fills the sequence, and its rest opens the next one; so all sequences but a partition's last
are full unless the segment limit binds.

Every partition packs by itself, in blocks of a bounded number of examples: no shuffle, no state on the driver,
and a lost task packs its own partition again in the same way. The cost is one part-filled sequence a partition.

Defined results: a null or empty text has only its end identifier; a null id is carried along; rows with equal ids are
separate examples; extra columns are not read; an empty table gives no rows. In pack_examples() a null number is 0, and an example
without tokens has no piece. An example that is over a limit by itself is cut
into whole sequences, with `cut` or without, as nothing else can hold it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerloom.llm.common import shipped
from ledgerloom.llm.tokenise import CACHE_PIECES, pieces

#: Examples that are packed together.
BLOCK = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Places blocks of examples; the last sequence of a block stays open for the next block."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool):
        self.limits = (max_tokens, max_segments, max_loss)
        self.cut = cut
        self.sequence = -1
        self.new()

    def new(self) -> None:
        self.sequence += 1
        self.tokens, self.segments, self.loss = self.limits
        self.offset = 0

    def take(self, item: int, start: int, length: int, loss: int) -> tuple[int, int, int, int, int]:
        out = (item, start, length, self.sequence, self.offset)
        self.tokens, self.segments, self.loss, self.offset = self.tokens - length, self.segments - 1, self.loss - loss, self.offset + length
        return out

    def place(self, sizes: np.ndarray, losses: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(example, start, length, sequence, offset) for every piece. Examples that are cut bear loss on all tokens or none."""
        most = min(self.limits[0], self.limits[2])
        order = np.lexsort((-losses, -sizes))
        kinds, first = np.unique(np.stack([-sizes[order], -losses[order]]), axis=1, return_index=True) if len(sizes) else (np.zeros((2, 0), int), [])
        stacks = [list(x[::-1]) for x in np.split(order, first[1:])] if len(sizes) else []
        size, loss = -kinds.astype(np.int64)
        left = np.array([len(x) for x in stacks], np.int64)
        for k in np.flatnonzero((size > self.limits[0]) | (loss > self.limits[2])):  # nothing holds these whole
            for item in stacks[k]:
                step, start = (most if loss[k] else self.limits[0]), 0
                while start < size[k]:
                    if self.offset:
                        self.new()
                    n = min(step, int(size[k]) - start)
                    yield self.take(item, start, n, n if loss[k] else 0)
                    start += n
            left[k] = 0
        a, c = size / self.limits[0], loss / max(1, self.limits[2])
        remaining = int(left.sum())
        if (loss == size).all():  # the product rises with the one length that is left, so the longest example that fits has the largest
            yield from self.longest_first(stacks, size.tolist(), left.tolist(), remaining)
            return
        while remaining:
            if not self.segments or not self.tokens:
                self.new()
            fits = (left > 0) & (size <= self.tokens) & (loss <= self.loss)
            score = np.where(fits, a * (self.tokens / self.limits[0]) + c * (self.loss / max(1, self.limits[2])), -1.0)
            k = int(score.argmax())
            if score[k] >= 0:
                left[k] -= 1
                remaining -= 1
                yield self.take(stacks[k].pop(), 0, int(size[k]), int(loss[k]))
                continue
            head = min(self.tokens, self.loss)
            whole = np.flatnonzero((left > 0) & (loss == size)) if self.cut and head else ()
            if not len(whole):
                self.new()
                continue
            k = int(whole[0])  # the longest
            item, n = stacks[k].pop(), int(size[k])
            left[k] -= 1
            remaining -= 1
            yield self.take(item, 0, head, head)
            self.new()
            yield self.take(item, head, n - head, n - head)

    def longest_first(self, stacks: list[list[int]], size: list[int], left: list[int], remaining: int) -> Iterator[tuple[int, int, int, int, int]]:
        """place() for examples whose every token bears loss, of kinds by descending length: the same choices, found by bisection."""
        after = list(range(len(size) + 1))  # of each kind, the first from it on that has examples left

        def alive(k: int) -> int:
            while after[k] != k:
                after[k] = after[after[k]]
                k = after[k]
            return k

        for k, n in enumerate(left):
            if not n:
                after[k] = k + 1
        while remaining:
            if not self.segments or not self.tokens:
                self.new()
            room = min(self.tokens, self.loss)
            k = alive(bisect_left(size, -room, key=lambda n: -n))
            cut = k == len(size)
            if cut:
                k = alive(0)
                if not (self.cut and room):
                    self.new()
                    continue
            item, n = stacks[k].pop(), size[k]
            left[k] -= 1
            remaining -= 1
            if not left[k]:
                after[k] = k + 1
            if cut:  # the longest fills the sequence, and its rest opens the next
                yield self.take(item, 0, room, room)
                self.new()
                yield self.take(item, room, n - room, n - room)
            else:
                yield self.take(item, 0, n, n)


def pack_texts(docs: DataFrame, tokenizer: str, end_id: int = 1, max_tokens: int = 2048, max_segments: int | None = None, max_loss: int | None = None, block: int = BLOCK, cache: int = CACHE_PIECES) -> DataFrame:
    """Packs all texts of `docs` (doc_id, text) as examples whose every token bears loss; one row per piece. Without a limit of segments
    as many short texts share a sequence as it holds."""
    shipped(docs.sparkSession)
    limits = (max_tokens, max_segments or max_tokens, max_loss or max_tokens)
    end = np.array([end_id], "<u4").tobytes()
    names = [x.rsplit(" ", 1)[0].strip() for x in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces(tokenizer, most=cache).encode
        packer = Packer(*limits, cut=True)
        first = TaskContext.get().partitionId() << 32
        step = min(limits[0], limits[2])
        held: list[tuple[int | None, int, bytes, int]] = []

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * len(names), names=names)

        def packed() -> list[tuple]:
            sizes = np.array([len(ids) // 4 for _, _, ids, _ in held], np.int64)
            out = []
            for item, start, length, sequence, offset in packer.place(sizes, sizes):
                doc, base, ids, total = held[item]
                out.append((doc, base + start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, first + sequence, offset, length))
            held.clear()
            return out

        alone = 1 << 31  # sequences that one piece fills are numbered from here in the partition
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                total = len(ids) // 4
                full = total // step * step
                for start in range(0, full, step):
                    out.append((doc, start, step, zlib.crc32(ids[4 * start : 4 * (start + step)]), total, first + alone, 0, step))
                    alone += 1
                if full < total:
                    held.append((doc, full, ids[4 * full :], total))
                if len(held) >= block:
                    out += packed()
            if out:
                yield rows(out)
        yield rows(packed())

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def pack_examples(examples: DataFrame, max_tokens: int = 2048, max_segments: int = 16, max_loss: int = 1024, cut: bool = False, block: int = BLOCK) -> DataFrame:
    """Packs instruction examples (example_id long, n_tokens long, n_loss long; nulls count as 0) and keeps each whole.

    Returns example_id, start, length, sequence_id, offset; an example without tokens has no piece.
    """
    shipped(examples.sparkSession)
    names = ["example_id", "start", "length", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(max_tokens, max_segments, max_loss, cut)
        first = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        held: list[tuple[int, int]] = []

        def packed() -> pa.RecordBatch:
            v = np.array(held, np.int64).reshape(-1, 2)
            out = [(ids[i], s, n, first + q, o) for i, s, n, q, o in packer.place(v[:, 0], v[:, 1])]
            ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names=names)

        for batch in batches:
            for i, n, loss in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (n or 0) > 0:
                    ids.append(i)
                    held.append((n, min(loss or 0, n)))
            if len(held) >= block:
                yield packed()
        yield packed()

    return examples.select("example_id", "n_tokens", "n_loss").mapInArrow(run, "example_id long, start long, length long, sequence_id long, offset long")
