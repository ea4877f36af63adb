"""Token-ID output: length-delimited binary records with a separate offset index.

A record is framed as in the public TFRecord format: its length (8 bytes), the masked CRC-32C of these, the payload, the
masked CRC-32C of the payload, all little-endian. The payload is the document id (8 bytes), a byte saying whether it is
null, a byte giving the width of an id (2 where the vocabulary allows, else 4), and the ids. Beside `part-n.rec` stands
`part-n.idx`: the offset of each record, 8 bytes each, so any record can be read without a scan.

Rows are range-partitioned by id and each partition writes one file, under a name of its own attempt that is then moved into
place; so a task that runs again, or twice at once, leaves one whole file. Files go to the shared folder through
pyarrow's file systems. Only one row per file (its counts) reaches the driver.

Checksums are computed for many records at once: CRC is linear, so four-byte words are looked up and then folded pairwise.

Defined results: a null or empty text is a record with only the end identifier; rows without an id come first; rows with
equal ids are records each, in order of their texts; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import new_folder, shipped, size_of, text_column
from ledgerloom.llm.tokenise import CACHE_PIECES, id_width, narrowed, pieces

#: The reflected Castagnoli polynomial and the mask of the public record format.
POLYNOMIAL = 0x82F63B78
MASK_ADD, MASK_SHIFT = 0xA282EAD8, 15
#: Bytes gathered before they are framed and written.
FLUSH = 4 << 20
#: Bytes of texts for one file, by Spark's estimate, where the session's shuffle partitions would make larger ones.
FILE_BYTES = 1 << 28


@lru_cache(1)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return t


@lru_cache(64)
def _byte_shift(level: int) -> np.ndarray:
    """Four tables of 256: how each byte of a CRC state changes over 2^level zero bytes."""
    s = np.arange(256, dtype=np.uint32)
    if level == 0:
        return np.stack([_byte_table()[s], s, s << np.uint32(8), s << np.uint32(16)])
    half = _byte_shift(level - 1)
    over = lambda x: half[0][x & 0xFF] ^ half[1][x >> 8 & 0xFF] ^ half[2][x >> 16 & 0xFF] ^ half[3][x >> 24]
    return np.stack([over(over(s << np.uint32(8 * k))) for k in range(4)])


@lru_cache(64)
def _shift_table(level: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for the low and the high half of a state."""
    t, x = _byte_shift(level), np.arange(1 << 16)
    return t[0][x & 0xFF] ^ t[1][x >> 8], t[2][x & 0xFF] ^ t[3][x >> 8]


def _shifted(state: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    halves = np.ascontiguousarray(state).view("<u2")
    return table[0][halves[..., 0::2]] ^ table[1][halves[..., 1::2]]


def crc32c(blobs: list[bytes]) -> np.ndarray:
    """CRC-32C of each string. Strings of one size class, padded in front by zeros, are folded together."""
    out = np.zeros(len(blobs), np.uint32)
    classes: dict[int, list[int]] = {}
    for i, b in enumerate(blobs):
        classes.setdefault(max(2, (max(len(b), 1) - 1).bit_length()), []).append(i)
    for level, members in classes.items():
        size = 1 << level
        step = max(1, FLUSH // size)
        for s in range(0, len(members), step):
            part = members[s : s + step]
            # the start value of all ones is the same as the first four bytes inverted; shorter strings get it by a shift
            raw = np.frombuffer(b"".join([blobs[i].rjust(size, b"\0") for i in part]), "<u4").reshape(len(part), -1)
            state = _shifted(raw, _shift_table(2))
            for k in range(2, level):
                state = _shifted(state[:, 0::2], _shift_table(k)) ^ state[:, 1::2]
            lengths = np.array([len(blobs[i]) for i in part])
            out[part] = state[:, 0] ^ _start(lengths)
    return out ^ np.uint32(0xFFFFFFFF)


def _start(lengths: np.ndarray) -> np.ndarray:
    """What the start value of all ones becomes over so many bytes."""
    state = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        state = np.where(lengths >> k & 1, _shifted(state, _shift_table(k)), state)
    return state


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return (crc >> np.uint32(MASK_SHIFT) | crc << np.uint32(32 - MASK_SHIFT)) + np.uint32(MASK_ADD)


def framed(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a record."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    head_sums, sums = masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist()
    return [b"".join((h, struct.pack("<I", a), p, struct.pack("<I", b))) for h, a, p, b in zip(heads, head_sums, payloads, sums)]


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder. A path without a scheme is local."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def payload(doc: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<qBB", doc or 0, doc is None, width) + narrowed(ids, width)


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and ids of a payload."""
    doc, none, width = struct.unpack_from("<qBB", data)
    return None if none else doc, np.frombuffer(data, "<u2" if width == 2 else "<u4", offset=10)


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, width: int | None = None, cache: int = CACHE_PIECES) -> tuple[str, list[dict]]:
    """Writes all texts of `docs` (doc_id, text) in ascending id order; returns the folder and a row per file. Ids take `width` bytes, or
    what the vocabulary needs."""
    spark = shipped(docs.sparkSession)
    width = width or id_width(tokenizer, end_id)
    folder = folder or new_folder(spark, "records")
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces(tokenizer, most=cache).encode
        task = TaskContext.get()
        fs, path = opened(folder)
        n = task.partitionId()
        own = f"{path}/.attempt-{n:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        count = n_ids = at = 0
        offsets: list[int] = []
        waiting: list[bytes] = []
        held = 0
        with fs.open_output_stream(f"{own}.rec") as f, fs.open_output_stream(f"{own}.idx") as g:

            def flush() -> None:
                nonlocal at, held
                for r in framed(waiting):
                    offsets.append(at)
                    at += len(r)
                    f.write(r)
                g.write(np.array(offsets, "<u8").tobytes())
                offsets.clear()
                waiting.clear()
                held = 0

            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = encode(text) + end
                    count, n_ids = count + 1, n_ids + len(ids) // 4
                    waiting.append(payload(doc, ids, width))
                    held += len(waiting[-1])
                    if held >= FLUSH:
                        flush()
            flush()
        for kind in ("rec", "idx"):
            if count:
                fs.move(f"{own}.{kind}", f"{path}/part-{n:06d}.{kind}")
            else:
                fs.delete_file(f"{own}.{kind}")
        if count:
            yield pa.RecordBatch.from_pydict({"part": [n], "records": [count], "ids": [n_ids], "bytes": [at]}, pa.schema([(c, pa.int64()) for c in ("part", "records", "ids", "bytes")]))

    source = docs.select("doc_id", text_column())
    n = -(-size_of(source) // FILE_BYTES)
    dealt = source.repartitionByRange(n, "doc_id") if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else source.repartitionByRange("doc_id")
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    files = sorted((r.asDict() for r in ordered.mapInArrow(run, "part long, records long, ids long, bytes long").collect()), key=lambda r: r["part"])
    return folder, files


def records_in(f: pa.NativeFile, offsets: np.ndarray, end: int) -> Iterator[bytes]:
    """Payloads of a file's records in order, all checksums checked, in reads of a few megabytes."""
    bounds = np.concatenate([offsets, [end]]).astype(np.int64)
    first = 0
    while first < len(offsets):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + FLUSH, "right")) - 1)
        f.seek(int(bounds[first]))
        block = f.read(int(bounds[last] - bounds[first]))
        cuts = (bounds[first : last + 1] - bounds[first]).tolist()
        frames = [block[a:b] for a, b in zip(cuts, cuts[1:])]
        payloads = [x[12:-4] for x in frames]
        heads = np.array([struct.unpack_from("<QI", x) for x in frames], np.uint64)
        tails = np.array([struct.unpack_from("<I", x, len(x) - 4)[0] for x in frames], np.uint32)
        if (
            (heads[:, 0] != np.array([len(p) for p in payloads], np.uint64)).any()
            or (masked(crc32c([x[:8] for x in frames])) != heads[:, 1].astype(np.uint32)).any()
            or (masked(crc32c(payloads)) != tails).any()
        ):
            raise ValueError("a record's length or checksum is wrong")
        yield from payloads
        first = last


def read_records(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, place) for every record of the files, in whatever order."""
    shipped(spark)
    starts = np.concatenate([[0], np.cumsum([r["ids"] for r in files])]).tolist() if files else []
    rows = [(r["part"], r["bytes"], s) for r, s in zip(files, starts)]
    table = spark.createDataFrame(rows, "part long, bytes long, start long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_stream(f"{path}/part-{r['part']:06d}.idx") as g:
                    offsets = np.frombuffer(g.read(), "<u8")
                out: list[tuple] = []
                start = r["start"]
                with fs.open_input_file(f"{path}/part-{r['part']:06d}.rec") as f:
                    for place, data in enumerate(records_in(f, offsets, r["bytes"])):
                        doc, ids = parsed(data)
                        out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), r["part"], place))
                        start += len(ids)
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)
                            out.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "part", "place"]
    return table.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def read_at(folder: str, part: int, places: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Single records by their places in a file, in any order, through the index: the shuffled read of a trainer."""
    fs, path = opened(folder)
    with fs.open_input_stream(f"{path}/part-{part:06d}.idx") as g:
        offsets = np.frombuffer(g.read(), "<u8")
    with fs.open_input_file(f"{path}/part-{part:06d}.rec") as f:
        end = f.size()
        for k in places:
            stop = int(offsets[k + 1]) if k + 1 < len(offsets) else end
            yield from (parsed(p) for p in records_in(f, offsets[k : k + 1], stop))
