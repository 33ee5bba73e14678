"""What the text operators share: scratch tables, block counts and byte-level tokens.

Scratch tables are Parquet files in the folder that ``spark.checkpoint.dir`` names, which all
executors share. They cut lineage: a lost executor makes Spark read the files again instead of
computing again what led to them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder for scratch tables where the session names none, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/gridloom"

#: The white space of the contracts: space and the bytes 0x09 to 0x0D. ``bytes.split()`` cuts at just these.
WHITE = r"[\x20\x09-\x0D]+"

#: Who is told of scratch tables, in this thread.
_recorders: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints. Where none is set, a local one if all runs on this machine; on a cluster there must be one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or LOCAL_CHECKPOINTS


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gridloom-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    delete_on_exit(spark, path)
    for tables in _recorders.get():
        tables.append(path)
    return spark.read.schema(schema).parquet(path)


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_on_exit(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)


@contextmanager
def recorded(into: list[str]) -> Iterator[None]:
    """Add the scratch tables that this thread writes meanwhile to ``into``."""
    token = _recorders.set((*_recorders.get(), into))
    try:
        yield
    finally:
        _recorders.reset(token)


def release(spark: SparkSession, tables: list[str]) -> None:
    """Delete scratch tables. Only safe once every result that reads them is stored."""
    while tables:
        p, fs = _hadoop_path(spark, tables.pop())
        fs.delete(p, True)


def content_bytes(df: DataFrame) -> int:
    """The bytes of all texts and binaries of ``df`` as they are in memory, and 16 for each row; a file's size says little of a corpus of copies."""
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    return df.agg(F.sum(sum(texts, F.lit(16)).cast("long")).alias("b")).first()["b"] or 0


def block_count(df: DataFrame, block_bytes: int, least: int = 1) -> int:
    """So many blocks that each holds about ``block_bytes`` of ``df``."""
    return max(least, math.ceil(content_bytes(df) / block_bytes))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that long texts do not add up."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of texts, A-Z lower-cased, cut at white space: the distinct words, each token's place among them, each text's number of tokens."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    tokens = split.flatten().dictionary_encode()
    words, at = tokens.dictionary.cast(pa.binary()), tokens.indices.to_numpy()
    n = np.diff(split.offsets.to_numpy())
    empty = pc.index(tokens.dictionary, "").as_py()
    if empty >= 0:  # white space at the ends leaves empty parts
        full = at != empty
        n = np.diff(np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(n)])])
        at = at[full]
    return words, at, n


def crc_remainder(doc_id: str, modulus: int):
    """crc32 of ``doc_id`` as text, modulo ``modulus``; null where the id is null."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
