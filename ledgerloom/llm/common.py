"""Helpers shared by the operators: reading tables, Arrow batches, written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch, unless the caller has set another number. Spark ends a batch earlier at 64 MB
#: (spark.sql.execution.arrow.maxBytesPerBatch), so very long texts do not add up.
BATCH_ROWS = 512
#: Rows of a few numbers each, some 100 bytes in a broadcast, up to which few() has a side sent to every executor.
FEW_ROWS = 400_000
#: Estimated bytes of an input up to which spread() deals it to all cores.
SMALL_BYTES = 32 << 20
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What lean() sets, and Spark's own defaults. Row groups of 8 MB, as a task holds one whole where it writes or reads; reads of others in
#: pieces of 256 kB, as one piece of a row group's length needs a free stretch of heap as long; decoded texts of as many rows as a batch.
LEAN = {
    "parquet.block.size": (str(8 << 20), None),
    "parquet.hadoop.vectored.io.enabled": ("false", None),
    "parquet.read.allocation.size": (str(256 << 10), None),
    "spark.sql.parquet.columnarReaderBatchSize": (str(BATCH_ROWS), "4096"),
}
#: Files whose footers are read to learn how large row groups are.
LOOKED = 32
ROOT = Path(__file__).resolve().parents[2]
#: Bytes that one call handles at a time where work on a text needs several arrays of its length.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, of which only `columns` are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shipped(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers that were not started with its folder in their path."""
    if spark.conf.get(ARROW_ROWS) == "10000":  # Spark's own default
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in known or os.getcwd() == str(ROOT) or getattr(spark.sparkContext, "_ledgerloom_shipped", False):
        return spark
    path = Path(tempfile.mkdtemp()) / "ledgerloom_src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in (ROOT / "ledgerloom").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._ledgerloom_shipped = True
    return spark


def lean(spark: SparkSession) -> SparkSession:
    """Has tasks of this session hold little of a Parquet file, so that every core can read and write long texts at once in a small heap.
    What the session or cluster has set otherwise stays."""
    cluster = spark._jsc.hadoopConfiguration()
    for name, (value, default) in LEAN.items():
        if spark.conf.get(name, None) == default and cluster.get(name) is None:
            spark.conf.set(name, value)
    return spark


def heap_bytes(spark: SparkSession) -> int:
    """Heap of an executor, which in a local session is the driver."""
    jvm, sc = spark._jvm, spark.sparkContext
    if sc.master == "local" or sc.master.startswith("local["):
        return jvm.java.lang.Runtime.getRuntime().maxMemory()
    return jvm.org.apache.spark.network.util.JavaUtils.byteStringAsMb(sc.getConf().get("spark.executor.memory", "1g")) << 20


def largest_group(df: DataFrame) -> int:
    """Bytes of the largest row group in the Parquet files that `df` reads, by the footers of the LOOKED largest; 0 if it reads none."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    files = []
    for f in df.inputFiles():
        if f.endswith(".parquet"):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
            files.append((path.getFileSystem(conf).getFileStatus(path).getLen(), f, path))
    most = 0
    for length, _, path in sorted(files, key=lambda x: x[:2], reverse=True)[:LOOKED]:
        if length > most:  # else none of its groups is larger
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
            most = max([most, *[b.getCompressedSize() for b in reader.getFooter().getBlocks()]])
            reader.close()
    return most


def few_at_once(df: DataFrame) -> DataFrame:
    """`df`, read by so few tasks that the row groups they hold fit in a third of the heaps. All rows are read, only fewer at a time; where all
    cores can read at once, `df` itself."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    third = heap_bytes(spark) // 3
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
    tasks = max(1, third // max(1, largest_group(df))) * executors
    return df if tasks >= cores else df.coalesce(tasks)


def regrouped(df: DataFrame) -> DataFrame:
    """`df`, or where its row groups don't fit the heap of all cores at once a copy in small ones, written by few_at_once()."""
    lean(df.sparkSession)
    few_ = few_at_once(df)
    return df if few_ is df else written(few_, "regrouped")


def in_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """Applies `fn` to each Arrow batch; every input row gives one output row, in place."""
    shipped(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return df.mapInArrow(run, schema)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows, for jobs that run inside the block on a few numbers a row."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for shared intermediates. A local session may leave it unset and gets a temporary one; a cluster
    may not, as its executors share no temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not getattr(sc, "_ledgerloom_dir", None):
        sc._ledgerloom_dir = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
    return sc._ledgerloom_dir


def _noted(spark: SparkSession) -> list[str]:
    """The folders of intermediates that this session has written and not yet deleted."""
    sc = spark.sparkContext
    if not hasattr(sc, "_ledgerloom_written"):
        sc._ledgerloom_written = []
    return sc._ledgerloom_written


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which clean() will delete."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _noted(spark).append(path)
    return path


def deleted(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _noted(spark):
        _noted(spark).remove(path)


def clean(spark: SparkSession) -> None:
    """Deletes all intermediates of this session. Results that have not been read yet may need them, so the caller says when."""
    for path in list(_noted(spark)):
        deleted(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.written_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what written() made for `df`, if nothing will read it again."""
    path = getattr(df, "written_path", None)
    if path:
        deleted(df.sparkSession, path)


def few(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row: to be broadcast if it is counted to have no more than FEW_ROWS; else as it is, and a
    join deals both sides."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def size_of(df: DataFrame) -> int:
    """Bytes of `df` as Spark's optimiser estimates them, from the sizes of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """A small input, which may stand in one row group, dealt to all cores; a larger one as it is, without a shuffle."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size_of(df) <= SMALL_BYTES else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own, which no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    prefix = "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def own_prefix(df: DataFrame) -> str:
    """A prefix that no column of `df` begins with."""
    prefix = "_own_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def text_column(name: str = "text"):
    """The column with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit("")).alias(name)
