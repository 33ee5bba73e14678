"""Readers and writers: edge lists, dense text, labels, and column-compressed matrices in text and binary.

Files are read through Spark's own readers, so any store that Spark knows will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..matrix import CoordMatrix
from ..session import cut

#: Places of a compressed matrix that are handled together: a block's columns are found by one sort.
BLOCK = 1 << 16

VALUE_TYPES = {"float64": "<f8", "uint8": "u1"}


def read_edges(spark: SparkSession, path: str, value: bool = False) -> DataFrame:
    """White-space separated pairs (triples with ``value``); plain or gzip."""
    p = F.split(F.trim("value"), r"[\s,]+")
    cols = [F.get(p, F.lit(0)).cast("bigint").alias("row"), F.get(p, F.lit(1)).cast("bigint").alias("col")]
    cols.append(F.get(p, F.lit(2)).cast("double").alias("value") if value else F.lit(1.0).alias("value"))
    return spark.read.text(path).filter(F.trim("value") != "").select(*cols)


def read_network(spark: SparkSession, users: str, user_user: str, user_group: str) -> tuple[DataFrame, DataFrame]:
    """Friendships and memberships among the listed users."""
    ids = spark.read.text(users).select(F.trim("value").cast("bigint").alias("id")).filter("id is not null").distinct()
    uu, ug = read_edges(spark, user_user), read_edges(spark, user_group)
    left, right = ids.select(F.col("id").alias("row")), ids.select(F.col("id").alias("col"))
    return uu.join(left, "row", "left_semi").join(right, "col", "left_semi"), ug.join(left, "row", "left_semi")


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` of (value, file, start) as Spark reads them, with n: their place, from 0, in the order of the files' names and of the ranges within files.

    Spark splits text files by byte ranges, each read in order by one task. The driver gets the number of rows of each range."""
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    ranges = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("size")).orderBy("file", "start").collect()  # one row a byte range
    before, table = 0, []
    for r in ranges:
        table.append((r["file"], r["start"], before - r["first"]))
        before += r["size"]
    shift = rows.sparkSession.createDataFrame(table, "file string, start bigint, shift bigint")
    return rows.join(F.broadcast(shift), ["file", "start"]).select((F.col("at") + F.col("shift")).alias("n"), "value")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def read_dense(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(row, col, value) of numbers in lines; with ``header`` the first line gives the shape. A file, or a folder of files in the order of their names."""
    lines = _placed(_lines(spark, path))
    lines = lines.filter("n > 0").withColumn("n", F.col("n") - 1) if header else lines
    return lines.filter(F.trim("value") != "").select(F.col("n").alias("row"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "v")).select("row", F.col("col").cast("bigint").alias("col"), F.col("v").cast("double").alias("value")).filter("value <> 0")


def read_labels(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """(id, cluster) from a count and then one label a line; raises if the count is wrong."""
    lines = _numbers(spark, path)
    count = lines.filter("n = 0").select(F.col("v").cast("bigint")).first()[0]
    labels = lines.filter("n > 0").select((F.col("n") - 1).cast("bigint").alias("id"), (F.col("v").cast("int") - offset).alias("cluster"))
    if (found := labels.count()) != count:
        raise ValueError(f"{path}: {count} labels announced, {found} found")
    return labels


def write_labels(labels: DataFrame, path: str, offset: int = 0) -> None:
    n = labels.count()
    head = labels.sparkSession.createDataFrame([(-1, str(n))], "id bigint, line string")
    body = labels.select("id", (F.col("cluster") + offset).cast("string").alias("line"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("id").select("line").write.mode("overwrite").text(path)  # the format is one ordered file


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """(n, v): the words of a file, or of a folder of files, with their places."""
    words = _lines(spark, path).select(F.explode(F.split("value", r"\s+")).alias("value"), "file", "start").filter("value <> ''")
    return _placed(words).withColumnRenamed("value", "v")


def read_ccs_text(spark: SparkSession, name: str, scaling: str = "txx") -> tuple[CoordMatrix, list[int]]:
    """Four files, or folders of files, <name>_dim, _row_ccs, _col_ccs and _<scaling>_nz; also the ids of empty columns.

    A place's column is the last one that begins at or before it; places are dealt by blocks, and a column that goes on into a block begins there again, so a column
    of any size is read by many tasks."""
    r, c = (int(x["v"]) for x in _numbers(spark, f"{name}_dim").filter("n < 2").orderBy("n").collect())
    pointers = _numbers(spark, f"{name}_col_ccs").select("n", F.col("v").cast("bigint").alias("p"))
    spans = pointers.join(pointers.select((F.col("n") - 1).alias("n"), F.col("p").alias("q")), "n")
    blocks = F.sequence(F.floor(F.col("p") / BLOCK), F.floor((F.col("q") - 1) / BLOCK))
    none = F.lit(None)
    starts = spans.filter("q > p").select("n", "p", F.explode(blocks).alias("block")).select("block", F.greatest("p", F.col("block") * BLOCK).alias("at"), F.col("n").alias("col"), none.cast("bigint").alias("row"), none.cast("double").alias("value"))
    rows = _numbers(spark, f"{name}_row_ccs").select(F.col("n").alias("at"), F.col("v").cast("bigint").alias("row"))
    values = _numbers(spark, f"{name}_{scaling}_nz").select(F.col("n").alias("at"), F.col("v").cast("double").alias("value"))
    places = rows.join(values, "at").select(F.floor(F.col("at") / BLOCK).alias("block"), "at", none.cast("bigint").alias("col"), "row", "value")
    upto = Window.partitionBy("block").orderBy("at", F.col("col").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    cells = starts.unionByName(places).withColumn("col", F.last("col", ignorenulls=True).over(upto)).filter("row is not null").select("row", "col", "value")
    return CoordMatrix(cells, r, c), [x["n"] for x in spans.filter("q = p").select("n").orderBy("n").collect()]


def write_ccs_text(m: CoordMatrix, name: str, scaling: str = "txx") -> None:
    """The same four as folders of part files: laid one after the other in the order of their names, the parts are the file.

    Cells are sorted by ranges of (column, row); column pointers are prefix sums within blocks of columns behind the sums of the blocks before."""
    spark = m.cells.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = cut(m.cells.repartitionByRange(tasks, "col", "row").sortWithinPartitions("col", "row").select("row", "col", "value"))  # rows and values in one order
    save = lambda df, end: df.write.mode("overwrite").text(f"{name}_{end}")
    save(cells.select(F.col("row").cast("string")), "row_ccs")
    save(cells.select(F.col("value").cast("string")), f"{scaling}_nz")
    counts = cells.groupBy("col").agg(F.count("*").alias("k"))
    every = spark.range(m.n_cols + 1).select(F.col("id").alias("col"), F.floor(F.col("id") / BLOCK).alias("block"))
    every = cut(every.join(counts, "col", "left").select("col", "block", F.coalesce("k", F.lit(0)).alias("k")))
    sums = every.groupBy("block").agg(F.sum("k").alias("s"))
    before = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("before"))  # one row a block of columns
    own = F.sum("k").over(Window.partitionBy("block").orderBy("col")) - F.col("k")
    pointers = every.withColumn("own", own).join(before, "block").select("col", (F.col("own") + F.col("before")).alias("p"))
    save(pointers.repartitionByRange(tasks, "col").sortWithinPartitions("col").select(F.col("p").cast("string")), "col_ccs")
    save(spark.createDataFrame([(f"{m.n_rows} {m.n_cols} {cells.count()}",)], "value string"), "dim")


def _decoded(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                _, c, n = np.frombuffer(raw, "<u4", 3)
                pointers = np.frombuffer(raw, "<u4", int(c) + 1, 12)
                rows = np.frombuffer(raw, "<u4", int(n), 12 + 4 * (int(c) + 1))
                values = np.frombuffer(raw, kind, int(n), 12 + 4 * (int(c) + 1 + int(n)))
                cols = np.repeat(np.arange(int(c)), np.diff(pointers.astype(np.int64)))
                for k in range(0, int(n), 1 << 18):
                    part = slice(k, k + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[part].astype(np.int64)), pa.array(cols[part].astype(np.int64)), pa.array(values[part].astype(float))], names=["row", "col", "value"])

    return run


def read_ccs(spark: SparkSession, path: str, values: str = "float64") -> CoordMatrix:
    """Binary: u32 rows, columns, count; u32 column pointers; u32 row ids; values as float64 or uint8."""
    files = spark.read.format("binaryFile").load(path)
    head = files.select(F.substring("content", 1, 12).alias("h")).first()["h"]
    r, c, _ = np.frombuffer(bytes(head), "<u4").tolist()
    return CoordMatrix(files.select("content").mapInArrow(_decoded(VALUE_TYPES[values]), "row long, col long, value double"), r, c)


def encode_ccs(m: CoordMatrix, values: str = "float64") -> bytes:
    """The same format from a matrix that fits on the driver, cells by column, then row."""
    t = m.cells.orderBy("col", "row").toPandas()
    if values == "uint8" and len(t) and not t["value"].between(0, 255).all():
        raise ValueError("values outside 0..255")
    pointers = np.concatenate([[0], np.cumsum(np.bincount(t["col"].to_numpy(int), minlength=m.n_cols))])
    own = np.floor(t["value"].to_numpy()).astype("u1") if values == "uint8" else t["value"].to_numpy().astype("<f8")
    parts = (np.array([m.n_rows, m.n_cols, len(t)]), pointers, t["row"].to_numpy())
    return b"".join(x.astype("<u4").tobytes() for x in parts) + own.tobytes()


def from_compressed(spark: SparkSession, rows: list[int], pointers: list[int], values: list[float], n_rows: int) -> CoordMatrix:
    cols = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers)).tolist()
    return CoordMatrix.from_rows(spark, zip(rows, cols, values, strict=True), (n_rows, len(pointers) - 1))


def write_coclusters(rows: DataFrame, cols: DataFrame, path: str) -> None:
    """(side, cluster, block, size, ids, signs): the ids of each cluster, sorted, in a row for each block of ``BLOCK`` ids; their signs, 1 where labels have none."""

    def side(x: DataFrame, name: str) -> DataFrame:
        sign = F.col("sign") if "sign" in x.columns else F.lit(1)
        members = x.select("cluster", F.floor(F.col("id") / BLOCK).alias("block"), F.struct("id", sign.cast("int").alias("sign")).alias("m"))
        lists = members.groupBy("cluster", "block").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("m")).alias("m"))  # at most BLOCK ids
        return lists.select(F.lit(name).alias("side"), "cluster", "block", "size", F.col("m.id").alias("ids"), F.col("m.sign").alias("signs"))

    both = side(rows, "row").unionByName(side(cols, "col"))
    both.repartitionByRange("side", "cluster", "block").sortWithinPartitions("side", "cluster", "block").write.mode("overwrite").parquet(path)


def merge_series(*series: DataFrame) -> DataFrame:
    """Plot series (series, x, y) together, in order of x."""
    out = series[0]
    for s in series[1:]:
        out = out.unionByName(s)
    return out.orderBy("series", "x")
