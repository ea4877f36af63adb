"""Token counts: a separator scan over flat token files that have no index.

A flat file is the ids of its documents one after the other, each followed by the end-of-document id. Files are cut into
blocks of equal size wherever that falls. One pass finds each block's separators by one array comparison and returns
their number and the last one's place. A prefix scan over these summaries (sums and running maxima by file, in
block order) tells every block how many documents end before it and how long the open one is already. The second pass
then emits each document in the block where it ends. Blocks are small and independent, so a very long document
costs no memory, and a lost task repeats its block only.

Files are written one per input partition, in the order in which the table is read, so nothing is shuffled.

Defined results: a null or empty text is a document of no tokens; a null id is carried along; rows with equal ids are
documents each; extra columns are not read; an empty table gives no rows. Tokens after a file's last
separator are one more document. Separator strings inside a text are ordinary text and never end a document.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import new_folder, shipped, text_column
from ledgerloom.llm.records import FLUSH, opened
from ledgerloom.llm.tokenise import id_width, narrowed, pieces

#: Ids in a block.
BLOCK = 1 << 20
WIDTHS = {2: "<u2", 4: "<u4"}


def write_flat(docs: DataFrame, tokenizer: str, separator: int, folder: str | None = None, width: int | None = None) -> tuple[str, list[dict]]:
    """Writes `docs` (doc_id, text) as they come, a file `part-n.bin` per partition, and the names (not the places) of its documents to
    `part-n.ids`. Ids take `width` bytes, or what the vocabulary needs.

    Returns the folder and (part, ids, width) per file.
    """
    spark = shipped(docs.sparkSession)
    width = width or id_width(tokenizer, separator)
    folder = folder or new_folder(spark, "flat")
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    end = np.array([separator], WIDTHS[width]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pieces(tokenizer, literal=True)
        task = TaskContext.get()
        fs, path = opened(folder)
        n, total, some = task.partitionId(), 0, False
        own = f"{path}/.attempt-{n:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{own}.bin") as f, fs.open_output_stream(f"{own}.ids") as g:
            waiting: list[bytes] = []
            held = 0
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    waiting += (narrowed(tokens.encode(text), width), end)
                    held += len(waiting[-2]) + width
                    some = True
                    g.write(struct.pack("<qB", doc or 0, doc is None))
                    if held >= FLUSH:
                        f.write(b"".join(waiting))
                        waiting.clear()
                        total, held = total + held // width, 0
            f.write(b"".join(waiting))
            total += held // width
        for kind in ("bin", "ids"):
            if some:
                fs.move(f"{own}.{kind}", f"{path}/part-{n:06d}.{kind}")
            else:
                fs.delete_file(f"{own}.{kind}")
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (n, total)], names=["part", "ids"])

    read = docs.select("doc_id", text_column())
    return folder, sorted((r.asDict() | {"width": width} for r in read.mapInArrow(run, "part long, ids long").collect()), key=lambda r: r["part"])


def block_ids(f: pa.NativeFile, block: int, size: int, width: int) -> np.ndarray:
    f.seek(block * size * width)
    return np.frombuffer(f.read(size * width), WIDTHS[width])


def blocks_of(spark: SparkSession, files: list[dict], size: int) -> DataFrame:
    """(part, ids, block) for every block of the files."""
    rows = spark.createDataFrame([(r["part"], r["ids"]) for r in files], "part long, ids long")
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("ids") - 1) / size)))))


def scanned(spark: SparkSession, folder: str, files: list[dict], separator: int, width: int | None = None, size: int = BLOCK) -> DataFrame:
    """(doc_id, part, place, start, n_tokens) for every document of the files; start counts the ids before it in its file, separators too.
    Ids have `width` bytes, or as many as the files say, else 2."""
    shipped(spark)
    width = width or max([r.get("width", 2) for r in files], default=2)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                with fs.open_input_file(f"{path}/part-{r['part']:06d}.bin") as f:
                    at = np.flatnonzero(block_ids(f, r["block"], size, width) == separator)
                out.append((r["part"], r["ids"], r["block"], len(at), r["block"] * size + int(at[-1]) + 1 if len(at) else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["part", "ids", "block", "ends", "after_last"])

    spread = blocks_of(spark, files, size).repartition("part", "block")
    seen = spread.mapInArrow(summaries, "part long, ids long, block long, ends long, after_last long")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = seen.select("part", "ids", "block", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("after_last").over(before), F.lit(0)).alias("open"))
    names = ["doc_id", "part", "place", "start", "n_tokens"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        for batch in batches:
            for r in batch.to_pylist():
                base = f"{path}/part-{r['part']:06d}"
                with fs.open_input_file(f"{base}.bin") as f:
                    ids = block_ids(f, r["block"], size, width)
                ends = np.flatnonzero(ids == separator) + r["block"] * size
                starts = np.concatenate([[r["open"]], ends + 1])
                if r["block"] * size + len(ids) == r["ids"] and starts[-1] < r["ids"]:
                    ends = np.concatenate([ends, [r["ids"]]])
                starts = starts[: len(ends)]
                docs = np.zeros(len(ends), [("doc", "<i8"), ("none", "u1")])
                docs["none"] = 1
                if len(ends) and fs.get_file_info(f"{base}.ids").is_file:
                    with fs.open_input_file(f"{base}.ids") as g:
                        g.seek(9 * r["first"])
                        got = np.frombuffer(g.read(9 * len(ends)), docs.dtype)
                    docs[: len(got)] = got
                place = r["first"] + np.arange(len(ends))
                columns = [pa.array(docs["doc"], pa.int64(), mask=docs["none"].astype(bool)), pa.array(np.full(len(ends), r["part"])), pa.array(place), pa.array(starts), pa.array(ends - starts)]
                yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in columns], names=names)

    return known.repartition("part", "block").mapInArrow(documents, ", ".join(f"{n} long" for n in names))
