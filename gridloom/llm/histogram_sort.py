"""Sharding by histogram sort.

The rows are ordered by (hash of the text, doc_id), so equal texts lie together. Splitters between
the parts of that order are found without moving rows: in each round every task counts the exact
bytes below candidate keys (probes), the driver adds the counts and narrows each splitter's
interval, until the bytes below it are within tolerance of its target or no key lies between
the interval's ends. Then the rows are exchanged once. A shard consists of several parts, so no
task sorts a whole shard; a row's slot is the number of rows in the shard's earlier parts and
its place in its own part.

Law ``bytes``: the shards' bytes differ from the mean by at most the tolerance and one row. A
group of equal texts is cut only where a shard ends inside it, by doc_id.

Defined results: null text has no bytes (size 1) and is ordered as the empty text; a null doc_id
comes before others. Rows equal in text and doc_id are alike and lie in the same shard. Fewer rows
than shards: some shards stay empty. No rows: no rows. Extra columns are not read.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

LOW, HIGH = -(1 << 63), (1 << 63) - 1
PROBES = 4096


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the sort key (h, i) of every row."""
    t = F.col(text).cast("string")
    i = F.coalesce(F.col(doc_id).cast("long"), F.lit(LOW))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(t, F.lit(""))).alias("text_crc32"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("h"), i.alias("i"))


def _packed(key: int) -> tuple[int, int]:
    return (key >> 64) + LOW, (key & ((1 << 64) - 1)) + LOW


def below(h: np.ndarray, i: np.ndarray, probes: list[tuple[int, int]]) -> np.ndarray:
    """For each key the number of probes at or below it; the probes ascend."""
    ph, pi = (np.array(x, dtype=np.int64) for x in zip(*probes, strict=True))
    heads, first = np.unique(ph, return_index=True)
    last = np.append(first[1:], len(ph))
    at = np.searchsorted(heads, h)
    at_ = np.minimum(at, len(heads) - 1)
    same = heads[at_] == h
    out = np.where(at < len(heads), first[at_], len(ph))
    for g in np.unique(at_[same]):
        rows = same & (at_ == g)
        out[rows] = first[g] + np.searchsorted(pi[first[g] : last[g]], i[rows], side="right")
    return out


def _histogram(probes: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = below(b.column(0).to_numpy(), b.column(1).to_numpy(), probes)
            np.add.at(size, at, b.column(2).to_numpy())
            rows += np.bincount(at, minlength=len(probes) + 1)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(size[used]), pa.array(rows[used])], names=["at", "size", "n"])

    return count


def counted(keys: DataFrame, probes: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each probe; at most one row for each interval reaches the driver."""
    size, rows = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in keys.select("h", "i", "size").mapInArrow(_histogram(probes), "at long, size long, n long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect():
        size[r["at"]], rows[r["at"]] = r["size"], r["n"]
    return list(np.cumsum(size[:-1]).tolist()), list(np.cumsum(rows[:-1]).tolist())


def splitters(keys: DataFrame, total: int, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """Keys that cut the order into ``parts`` of near equal bytes, each within ``tolerance`` of a part."""
    targets = [total * k / parts for k in range(1, parts)]
    slack = tolerance * total / parts
    ends = [(0, 0, (1 << 128) - 1, total)] * len(targets)  # low key and bytes below it, high key and bytes below it
    found: list[int | None] = [None] * len(targets)
    while open_ := [k for k in range(len(targets)) if found[k] is None]:
        each = max(3, PROBES // len(open_))
        probes = set()
        for (lo, _, hi, _), shared in Counter(ends[k] for k in open_).items():
            n = min(each * shared, hi - lo - 1)
            probes.update(lo + (hi - lo) * (j + 1) // (n + 1) for j in range(n))
        probes = sorted(probes)
        bytes_, _ = counted(keys, [_packed(p) for p in probes])
        for k in open_:
            lo, lo_b, hi, hi_b = ends[k]
            at = bisect.bisect_right(bytes_, targets[k])
            if at and probes[at - 1] > lo:
                lo, lo_b = probes[at - 1], bytes_[at - 1]
            if at < len(probes) and probes[at] < hi:
                hi, hi_b = probes[at], bytes_[at]
            ends[k] = (lo, lo_b, hi, hi_b)
            near, off = min(((lo, targets[k] - lo_b), (hi, hi_b - targets[k])), key=lambda x: x[1])
            if off <= slack or hi - lo <= 1:
                found[k] = near
    return [_packed(k) for k in found]


def _dealt(cuts: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = below(b.column("h").to_numpy(), b.column("i").to_numpy(), cuts) if cuts else np.zeros(b.num_rows, np.int64)
            yield b.append_column("part", pa.array(part.astype(np.int32)))

    return deal


def histogram_sort(keys: DataFrame, shards: int = 16, tolerance: float = 0.002, part_rows: int = 200_000) -> DataFrame:
    """``keys`` as :func:`keyed` makes them, plus shard and slot. ``part_rows``: about so many rows sorted in a task."""
    keys = scratch(keys, "shard-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    sub = max(4, math.ceil(total["n"] / shards / part_rows))
    cuts = sorted(splitters(keys, total["b"], shards, tolerance)) if total["n"] else []
    inner = sorted({*cuts, *splitters(keys, total["b"], shards * sub, 0.25)}) if total["n"] else []
    shard_of = np.searchsorted(np.array([(c[0] - LOW << 64) + c[1] - LOW for c in cuts], dtype=object), np.array([(c[0] - LOW << 64) + c[1] - LOW for c in inner], dtype=object), side="right")
    _, rows = counted(keys, inner) if inner else ([], [])
    starts, before = [0, *rows], {}
    for part, shard in enumerate([0, *shard_of.tolist()]):
        before.setdefault(shard, starts[part])
    fixed = keys.sparkSession.createDataFrame([(part, int(shard), starts[part] - before[shard]) for part, shard in enumerate([0, *shard_of.tolist()])], "part int, shard int, base long")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema) + ", part int"
    dealt = keys.mapInArrow(_dealt(inner), schema).join(F.broadcast(fixed), "part")  # a row for each part
    place = F.row_number().over(Window.partitionBy("part").orderBy("h", "i"))
    return dealt.withColumn("slot", (F.col("base") + place - 1).cast("long")).drop("part", "base")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    out = histogram_sort(keyed(docs), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
