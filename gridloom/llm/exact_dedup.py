"""Exact deduplication by Grace hash partitioning with complete content comparison.

1. Each scan task normalises its texts and keeps, per flush of bounded size, one representative
   of every distinct content in an open-addressing table; the other copies only carry the
   representative's id. A group that holds a third of all rows so shrinks to one row a flush.
2. The representatives are dealt by content hash (the first Grace level, a Spark exchange). In a
   task, a bucket that exceeds ``memory`` is dealt again by other hash bits to spill files in
   the task's own temporary folder, and so on, until a bucket fits an open-addressing
   table that compares complete contents. A bucket that only copies keep above the limit is
   not split further: its table holds each content once, and records are streamed past it.
3. Every row takes its group from its representative.

Defined results: null text counts as empty, and all empty texts are equal. Of rows with equal
text and equal doc_id each is returned and one is kept: the rows are alike, so which
one does not show. A null doc_id is the smallest. No rows: no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import WHITE, block_count, scratch, slices

FLUSH_BYTES = 24 << 20
BUCKET_BYTES = 32 << 20
EXCHANGE_BYTES = 8 << 20
FANOUT = 16


class ContentTable:
    """Open addressing with linear probing; a slot matches only if hash and complete content do."""

    def __init__(self, capacity: int = 1 << 10):
        self.slots = [-1] * capacity
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        slots = [-1] * (mask + 1)
        for entry, h in enumerate(self.hashes):
            i = h & mask
            while slots[i] >= 0:
                i = (i + 1) & mask
            slots[i] = entry
        self.slots = slots

    def find_or_add(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry of ``content`` and whether it is new."""
        slots, mask = self.slots, len(self.slots) - 1
        i = h & mask
        while (entry := slots[i]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, False
            i = (i + 1) & mask
        slots[i] = entry = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 100
        if 2 * len(self.hashes) > len(slots):
            self._grow()
        return entry, True


def normalised(texts: pa.Array) -> list[bytes]:
    """Null as empty, each run of white space as one space, in UTF-8."""
    return pc.replace_substring_regex(pc.fill_null(texts, ""), WHITE, " ").cast(pa.binary()).to_pylist()


def _representatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> row (a number of its own), doc_id, sha, rep (a uuid shared by the copies of a flush), content (the first copy's, else null)."""
    table, reps, number = ContentTable(), [], TaskContext.get().partitionId() << 40
    for batch in slices(batches):
        ids = batch.column(0)
        shas, own, contents = [], [], []
        for content in normalised(batch.column(1)):
            sha = hashlib.sha256(content).digest()
            entry, new = table.find_or_add(int.from_bytes(sha[:8], "little"), content)
            if new:
                reps.append(uuid.uuid4().bytes)
            shas.append(sha)
            own.append(reps[entry])
            contents.append(content if new else None)
        row = pa.array(range(number, number + len(shas)), pa.int64())
        number += len(shas)
        yield pa.RecordBatch.from_arrays([row, ids, pa.array(shas, pa.binary()), pa.array(own, pa.binary()), pa.array(contents, pa.binary())], names=["row", "doc_id", "sha", "rep", "content"])
        if table.bytes > FLUSH_BYTES:
            table, reps = ContentTable(), []


def _spilled(records: Iterable[tuple[bytes, bytes, bytes]], depth: int, folder: str) -> list[tuple[str, int, bool]]:
    """Deal records by hash bits of this depth to files; for each: path, bytes, whether it holds more than one content hash."""
    paths = [os.path.join(folder, uuid.uuid4().hex) for _ in range(FANOUT)]
    files = [open(p, "wb") for p in paths]  # noqa: SIM115
    sizes, seen, mixed = [0] * FANOUT, [None] * FANOUT, [False] * FANOUT
    try:
        for record in records:
            sha = record[1]
            at = sha[8 + depth] % FANOUT
            pickle.dump(record, files[at], protocol=pickle.HIGHEST_PROTOCOL)
            sizes[at] += len(record[2]) + 100
            mixed[at] |= seen[at] is not None and seen[at] != sha
            seen[at] = sha
    finally:
        for f in files:
            f.close()
    return [(p, n, m) for p, n, m in zip(paths, sizes, mixed, strict=True) if n or os.remove(p)]


def _records(path: str) -> Iterator[tuple[bytes, bytes, bytes]]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _classes(records: Iterable[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[bytes, bytes]]:
    """(rep, class) of records that fit: the class is the first representative with that content."""
    table, first = ContentTable(), []
    for rep, sha, content in records:
        entry, new = table.find_or_add(int.from_bytes(sha[:8], "little"), content)
        if new:
            first.append(rep)
        yield rep, first[entry]


def grace(records: Iterable[tuple[bytes, bytes, bytes]], memory: int = BUCKET_BYTES, depth: int = 0, marks: bool = False) -> Iterator[tuple[bytes, bytes] | None]:
    """(rep, class) of all records (rep, sha256, content), dealt to spill files until each bucket fits ``memory`` bytes.

    With ``marks``, None follows each bucket: all records of its classes have been given."""
    held, size, stream = [], 0, iter(records)
    for record in stream:
        held.append(record)
        size += len(record[2]) + 100
        if size > memory:
            break
    else:
        yield from _classes(held)
        if marks:
            yield None
        return
    with tempfile.TemporaryDirectory() as folder:

        def rest() -> Iterator[tuple[bytes, bytes, bytes]]:
            while held:
                yield held.pop()
            yield from stream

        for path, bytes_, mixed in _spilled(rest(), depth, folder):
            if bytes_ > memory and mixed and depth < 20:
                yield from grace(_records(path), memory, depth + 1, marks)
            else:
                yield from _classes(_records(path))
                if marks:
                    yield None
            os.remove(path)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records():
        for batch in slices(batches):
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)

    reps, classes = [], []
    for rep, cls in grace(records()):
        reps.append(rep)
        classes.append(cls)
        if len(reps) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.binary()), pa.array(classes, pa.binary())], names=["rep", "class"])
            reps, classes = [], []
    yield pa.RecordBatch.from_arrays([pa.array(reps, pa.binary()), pa.array(classes, pa.binary())], names=["rep", "class"])


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", exchange_bytes: int = EXCHANGE_BYTES) -> DataFrame:
    """Every row as doc_id, keep_id, group_size, kept, text_sha256."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    buckets = block_count(slim, exchange_bytes, least=4)
    rows = scratch(slim.mapInArrow(_representatives, "row long, doc_id long, sha binary, rep binary, content binary"), "exact")
    classes = rows.filter("content is not null").select("rep", "sha", "content").repartition(buckets, "sha").mapInArrow(_resolve, "rep binary, class binary")

    own = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row")
    flushed = rows.groupBy("rep").agg(F.min(own).alias("low"), F.count("*").alias("n"))
    reps = scratch(flushed.join(classes, "rep"), "exact-reps")
    groups = reps.groupBy("class").agg(F.min("low").alias("low"), F.sum("n").alias("group_size"))
    placed = reps.select("rep", "class").join(groups, "class").select("rep", F.col("low.doc_id").alias("keep_id"), F.col("low.row").alias("keep_row"), "group_size")
    out = rows.select("row", "doc_id", "sha", "rep").join(placed, "rep")
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _columns(batch: pa.RecordBatch) -> list[list]:
    return [c.to_pylist() for c in batch.columns]


def _local_winners(id_at: int, text_at: int, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each content in a flush the whole row with the smallest id, and the content's sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, best, held = ContentTable(), [], []

        def flush():
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                out = rows.take(pa.array([at for _, at, _ in best], pa.int64()))
                out = out.append_column(key, pa.array([sha for _, _, sha in best], pa.binary()))
                yield from out.to_batches(max_chunksize=512)

        at = size = 0
        for batch in slices(batches):
            held.append(batch)
            for i, content in zip(batch.column(id_at).to_pylist(), normalised(batch.column(text_at).cast(pa.string())), strict=True):
                sha = hashlib.sha256(content).digest()
                entry, new = table.find_or_add(int.from_bytes(sha[:8], "little"), content)
                own = ((i is not None, i or 0), at, sha)
                if new:
                    best.append(own)
                elif own[0] < best[entry][0]:
                    best[entry] = own
                at += 1
                size += len(content) + 100
            if size > FLUSH_BYTES:
                yield from flush()
                table, best, held, at, size = ContentTable(), [], [], 0, 0
        yield from flush()

    return run


def _winners(id_at: int, text_at: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def records():
            for batch in slices(batches):
                types[:] = [c.type for c in batch.columns[:-1]]
                texts = normalised(batch.column(text_at).cast(pa.string()))
                for *row, sha, content in zip(*_columns(batch), texts, strict=True):
                    i = row[id_at]
                    yield pickle.dumps(((i is not None, i or 0), row)), sha, content

        best: dict[bytes, tuple] = {}

        def flush():
            rows = [row for _, row in best.values()]
            for k in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 512], strict=True), types, strict=True)], names=names)
            best.clear()

        for found in grace(records(), marks=True):
            if found is None:
                yield from flush()
                continue
            own = pickle.loads(found[0])
            if found[1] not in best or own[0] < best[found[1]][0]:
                best[found[1]] = own
        yield from flush()

    return run


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", exchange_bytes: int = EXCHANGE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, whole: of equal texts the row with the smallest id; of rows equal in both, one."""
    names = docs.columns
    at = names.index(doc_id), names.index(text)
    key = "sha"
    while key.lower() in (n.lower() for n in names):
        key += "_"
    local = docs.mapInArrow(_local_winners(*at, key), StructType([*docs.schema.fields, StructField(key, BinaryType())]))
    return local.repartition(block_count(docs, exchange_bytes, least=4), key).mapInArrow(_winners(*at, names), docs.schema)


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND row_number() OVER (PARTITION BY n.t, doc_id) = 1 AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t"""
