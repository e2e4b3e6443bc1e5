"""What the corpus operators share: inputs, the shared folder, and column names."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for all operators: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: What operators keep in a Python worker from task to task, and how it goes.
KEEPERS: dict[str, Callable[[], None]] = {}


def relieve() -> None:
    """For the start of a task in a Python worker: what other operators keep there goes, and the memory that is free goes back to
    the machine, so that workers of a long session hold no more than the operator at hand needs."""
    for forget in KEEPERS.values():
        forget()
    gc.unfreeze()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(frames: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same batches in slices of some rows, so that a task holds what is made of few texts at once."""
    relieve()
    for b in frames:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    relieve()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own checkpoint folder.
    Only a local session, as in tests, gets one where none is set."""
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(base or "/tmp/checkpoints")
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder, so that later reads neither compute it again nor depend on an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """The same as a Parquet table: for whole texts, of which later steps may read some columns or rows only."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the table that ``kept`` wrote, when nothing will read it again."""
    files = df.inputFiles()
    if not files:
        return
    folder = files[0].rpartition("/")[0]
    if folder.rpartition("/")[2].startswith("kept-"):
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if rows <= most else df


def fresh(prefix: str) -> str:
    """A column name that no input has."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal doc_id, modulo n; null for a null doc_id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % n


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
