"""The trie of conversation prefixes, merged from partial tries.

A node is a distinct sequence of first turns; its key is 128 bits, the exclusive or of a hash of each turn with its number.
Only ids, hashes and byte counts leave the first scan; texts never do.

* Turns are sorted by ranges of (conversation, turn), so a conversation of any length is spread over tasks, and numbered from
  the counts of its parts. A conversation's keys are prefix sums within blocks of ``BLOCK`` turns that begin with the sum of the blocks before.
* Every task combines its prefixes into a partial trie: a table of nodes with members, the smallest member and the sorted ids of the
  conversations that end there. At most ``FLUSH`` rows are combined at once; a trie may come in several parts.
* Partial tries are merged by key, ``FAN_IN`` tasks' at a time, until one is left: members are summed (``_merged``) and
  end lists joined in order, in pieces of ``END_BLOCK`` ids (``_merged_ends``).
* Sums over subtrees are rolled up along chains: the nodes with one smallest member form a path. Totals of chains go up by doubling
  (chains 1, 2, 4, ... levels below), so the number of rounds is the logarithm of how often branches branch again, whatever the depth;
  running sums within a chain, by blocks again, then give every node its own (``_rolled``).

Two sequences with one key would be found when their last turns or parents are compared, and stop the job.

Defined results: rows without a conversation id belong to no conversation and are left out. Turns are ordered by number, null first; rows of
one number by their hash. Null role or text is empty. Repeated rows are turns each. A conversation without turns after rebuilding ends at the
root. No conversations: no nodes, no root either. Extra columns are not read. A remainder has the sign of the id, so -3 is rebuilt from 0.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

BLOCK = 4096
FLUSH = 1 << 18
FAN_IN = 32
END_BLOCK = 1 << 16
ROWS_A_TASK = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def _tasks(rows: DataFrame) -> int:
    """So many tasks that each gets about ``ROWS_A_TASK`` rows, and at least the session's partitions."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / ROWS_A_TASK))


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every turn as c, part (of the conversation, by place), number (from 0 within the part), before (turns in earlier parts), n (turns of the conversation), a, b (hashes), bytes."""
    words = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text)]
    slim = conversations.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).cast("long").alias("turn"), F.xxhash64(F.lit(1), *words).alias("a"), F.xxhash64(F.lit(2), *words).alias("b"), F.octet_length(words[1]).cast("long").alias("bytes"))
    slim = scratch(slim.filter("c is not null").withColumn("row", F.monotonically_increasing_id()), "turns")
    order = ["c", F.col("turn").asc_nulls_first(), "a", "b", "row"]  # row: many equal turns are ranges too
    sorted_ = scratch(slim.repartitionByRange(_tasks(slim), *order).sortWithinPartitions(*order).select("c", "a", "b", "bytes", F.monotonically_increasing_id().alias("at")), "sorted-turns")
    sorted_ = sorted_.withColumn("part", F.shiftright("at", 33))
    parts = sorted_.groupBy("c", "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    own = Window.partitionBy("c")  # a row for each task at most
    parts = parts.withColumn("before", F.sum("size").over(own.orderBy("part")) - F.col("size")).withColumn("n", F.sum("size").over(own))
    return sorted_.join(parts.drop("size"), ["c", "part"]).withColumn("number", F.col("at") - F.col("first") + F.col("before")).select("c", "number", "n", "a", "b", "bytes")


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Rows c, depth, s, t (the turn's part of the key), bytes, length: the turns of each conversation c after its first h have been replaced by
    the first h of conversation c - c % family, h = crc32(c) % heads. Depth 0 is the root."""
    conversations = scratch(turns.filter("number = 0").select("c", "n", (F.col("c") - F.col("c") % family).alias("base"), (F.crc32(F.col("c").cast("string")) % heads).alias("h")), "conversations")
    bases = conversations.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    known = conversations.join(bases, "base", "left").withColumn("h", F.when(F.col("c") == F.col("base"), 0).otherwise(F.col("h")))
    known = known.withColumn("led", F.least("h", F.coalesce("base_n", F.lit(0))))
    known = scratch(known.select("c", "base", "h", "led", (F.col("led") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "rebuilt-conversations")
    own = turns.join(known, "c").filter("number >= h").select("c", (F.col("led") + F.col("number") - F.col("h") + 1).alias("depth"), "a", "b", "bytes", "length")
    first = turns.filter((F.col("number") < heads - 1) & (F.col("c") % family == 0)).select(F.col("c").alias("base"), "number", "a", "b", "bytes")
    led = known.filter("h > 0").join(first, "base").filter("number < h").select("c", (F.col("number") + 1).alias("depth"), "a", "b", "bytes", "length")
    key = lambda k: F.xxhash64(F.lit(k), "depth", "a", "b")
    rows = own.unionByName(led).select("c", "depth", key(3).alias("s"), key(4).alias("t"), "bytes", "length")
    zero = F.lit(0).cast("long")
    return rows.unionByName(known.select("c", zero.alias("depth"), zero.alias("s"), zero.alias("t"), zero.alias("bytes"), "length"))


_PARTIAL = "k1 long, k2 long, p1 long, p2 long, depth long, bytes long, n long, low long, part int, ends array<long>"
_PARTIAL_NAMES = [x.split()[0] for x in _PARTIAL.split(", ")]


def _combined(cols: list[np.ndarray], part: int) -> pa.RecordBatch:
    """One row a node from rows k1, k2, p1, p2, depth, bytes, c, ends, which are sorted by c."""
    k1, k2, p1, p2, depth, size, c, ends = cols
    way = np.lexsort((k2, k1))  # keeps the order of c
    k1, k2, ends, c = k1[way], k2[way], ends[way], c[way]
    new = np.ones(len(way), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    first = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.add.reduceat(ends.astype(np.int64), first))).astype(np.int32), pa.array(c[ends]))
    own = [x[way][first] for x in (p1, p2, depth, size)]
    out = [k1[first], k2[first], *own, np.diff(np.append(first, len(way))), np.minimum.reduceat(c, first), np.full(len(first), part, np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, out), lists], names=_PARTIAL_NAMES)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial trie of rows c, block, depth, turn, s, t, bytes, ends, sorted by c and depth; a row that is no turn brings the key of the blocks before."""
    part = TaskContext.get().partitionId()
    waiting, held, last = [], 0, None
    for batch in batches:
        c, block, depth, turn, s, t, size, ends = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        if not len(c):
            continue
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        go_on = last is not None and last[:2] == (c[0], block[0])
        start = np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
        keys = []
        for k, x in enumerate((s, t)):
            sums = np.bitwise_xor.accumulate(x)
            sums = sums ^ np.where(start > 0, sums[start - 1], 0)
            keys.append(np.where(start == 0, sums ^ last[2][k], sums) if go_on else sums)
        last = (c[-1], block[-1], (keys[0][-1], keys[1][-1]))
        waiting.append([x[turn] for x in (*keys, keys[0] ^ s, keys[1] ^ t, depth, size, c, ends)])
        held += len(c)
        if held >= FLUSH:
            cols = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            if len(cols[0]):
                yield _combined(cols, part)
            waiting, held = [], 0
    if waiting and len((cols := [np.concatenate(x) for x in zip(*waiting, strict=True)])[0]):
        yield _combined(cols, part)


def partial_tries(rows: DataFrame) -> tuple[DataFrame, int]:
    """A table of all tasks' partial tries, and the number of tasks."""
    rows = scratch(rows, "rebuilt-turns")
    rows = rows.withColumn("block", (F.col("depth") / BLOCK).cast("long"))
    long = rows.filter(F.col("length") >= BLOCK).groupBy("c", "block").agg(F.bit_xor("s").alias("s"), F.bit_xor("t").alias("t"))
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = long.select("c", "block", *[F.bit_xor(x).over(earlier).alias(x) for x in ("s", "t")]).filter("block > 0")
    carried = carried.select("c", "block", (F.col("block") * BLOCK).alias("depth"), F.lit(False).alias("turn"), "s", "t", F.lit(0).cast("long").alias("bytes"), F.lit(False).alias("ends"))
    own = rows.select("c", "block", "depth", F.lit(True).alias("turn"), "s", "t", "bytes", (F.col("depth") == F.col("length")).alias("ends"))
    tasks = _tasks(rows)
    dealt = own.unionByName(carried).repartitionByRange(tasks, "c", "block").sortWithinPartitions("c", "depth", "turn")
    return scratch(dealt.mapInArrow(_partial, _PARTIAL), "partial-tries"), tasks


def _merged(tries: DataFrame, tasks: int) -> DataFrame:
    """One row a node: k1, k2, p1, p2, depth, bytes, n, low."""
    same = ["p1", "p2", "depth", "bytes"]
    table = tries.select("k1", "k2", "part", "n", "low", *[F.col(x).alias(f"{x}_{e}") for x in same for e in ("least", "most")])
    sums = [F.sum("n").alias("n"), F.min("low").alias("low"), *[f(f"{x}_{e}").alias(f"{x}_{e}") for x in same for e, f in (("least", F.min), ("most", F.max))]]
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        table = table.groupBy("k1", "k2", F.shiftright("part", FAN_IN.bit_length() - 1).alias("part")).agg(*sums)
    table = table.groupBy("k1", "k2").agg(*sums)
    alike = F.lit(True)
    for x in same:
        alike = alike & (F.col(f"{x}_least") == F.col(f"{x}_most"))
    return table.select("k1", "k2", *[F.col(f"{x}_least").alias(x) for x in same], F.when(alike, F.col("n")).otherwise(F.raise_error(F.lit("two sequences of turns have one key")).cast("long")).alias("n"), "low")


def _ends_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[np.ndarray]]]:
    """Sorted rows key..., first, ids as pieces of ids by key. What is not taken of a key is passed over."""

    def rows():
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(b.num_columns - 2)), strict=True))
            lists = b.column(b.num_columns - 1)
            offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k, key in enumerate(keys):
                yield key, ids[offsets[k] : offsets[k + 1]]

    source = rows()
    ahead = next(source, None)

    def pieces(key):
        nonlocal ahead
        while ahead is not None and ahead[0] == key:
            ids = ahead[1]
            ahead = next(source, None)
            yield ids

    while ahead is not None:
        key = ahead[0]
        yield key, (own := pieces(key))
        for _ in own:
            pass


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a key's ids joined in order up to ``END_BLOCK``."""
    names = ["k1", "k2", "part", "first", "ids"]
    out, held = [], 0

    def batch() -> pa.RecordBatch:
        keys = [pa.array([x[0][k] for x in out], pa.int32() if k == 2 else pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*keys, pa.array([int(x[1][0]) for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=names)

    for key, pieces in _ends_by_key(batches):
        waiting, size = [], 0
        for ids in pieces:
            waiting.append(ids)
            size += len(ids)
            if size >= END_BLOCK:
                out.append((key, np.concatenate(waiting)))
                held, waiting, size = held + size, [], 0
        if waiting:
            out.append((key, np.concatenate(waiting)))
            held += size
        if held >= FLUSH:
            yield batch()
            out, held = [], 0
    if out:
        yield batch()


def _merged_ends(tries: DataFrame, tasks: int) -> DataFrame:
    """Rows k1, k2, first, ids: who ends at a node, in pieces of increasing ids."""
    table = tries.filter("size(ends) > 0").select("k1", "k2", "part", F.col("ends")[0].alias("first"), F.col("ends").alias("ids"))
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        table = table.withColumn("part", F.shiftright("part", FAN_IN.bit_length() - 1)).repartition("k1", "k2", "part").sortWithinPartitions("k1", "k2", "part", "first")
        table = table.mapInArrow(_joined, "k1 long, k2 long, part int, first long, ids array<long>")
    return table.drop("part")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []

    def batch() -> pa.RecordBatch:
        k1, k2, sha = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sha)], names=["k1", "k2", "ends_sha256"])

    for key, pieces in _ends_by_key(batches):
        sha, comma = hashlib.sha256(), b""
        for ids in pieces:
            sha.update(comma + ",".join(map(str, ids.tolist())).encode())
            comma = b","
        rows.append((*key, sha.hexdigest()))
        if len(rows) >= 10_000:
            yield batch()
            rows = []
    if rows:
        yield batch()


def _chains(nodes: DataFrame) -> DataFrame:
    """The nodes with one smallest member are a path. m (that member), top, bottom, up (the chain above), leaves and saved, both over the chain and all chains below."""
    chains = nodes.groupBy(F.col("low").alias("m")).agg(F.min(F.struct("depth", "p1", "p2")).alias("t"), F.max("depth").alias("bottom"), F.sum((F.col("n") - 1) * F.col("bytes")).alias("saved"))
    chains = scratch(chains.select("m", F.col("t.depth").alias("top"), F.col("t.p1").alias("k1"), F.col("t.p2").alias("k2"), "bottom", "saved"), "chains")
    above = nodes.select("k1", "k2", F.col("low").alias("up"))
    hung = scratch(chains.filter("top > 0").join(above, ["k1", "k2"]).select("m", "up", "top"), "hung-chains")
    branched = hung.select(F.col("up").alias("m"), (F.col("top") - 1).alias("bottom")).distinct().withColumn("goes_on", F.lit(1))
    leaves = (1 - F.coalesce("goes_on", F.lit(0))).cast("long")
    state = chains.select("m", "top", "bottom", "saved").join(hung.select("m", "up"), "m", "left").join(branched, ["m", "bottom"], "left").select("m", "top", "bottom", "up", F.col("up").alias("to"), leaves.alias("leaves"), "saved")
    state = scratch(state, "chain-sums")
    while state.filter("to is not null").limit(1).count():
        more = state.filter("to is not null").groupBy(F.col("to").alias("m")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        hop = state.filter("to is not null").select(F.col("m").alias("to"), F.col("to").alias("further"))
        state = state.join(more, "m", "left").join(hop, "to", "left")
        both = [(F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in ("leaves", "saved")]
        state = scratch(state.select("m", "top", "bottom", "up", F.col("further").alias("to"), *both), "chain-sums")
    return state


def _rolled(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """Every node as m, depth, parent, n, n_children, n_leaves, saved, k1, k2."""
    null = lambda x: F.lit(None).cast(x)
    zero, block = F.lit(0).cast("long"), (F.col("depth") / BLOCK).cast("long")

    def row(m: str, depth: Column, **values: Column) -> list[Column]:
        kinds = {"n": "long", "k1": "long", "k2": "long", "parent": "long", "children": "long", "bottom": "boolean", "leaves": "long", "saved": "long"}
        return [F.col(m).alias("m"), depth.alias("depth"), *[values.get(x, zero if x in ("children", "leaves", "saved") else null(kind)).alias(x) for x, kind in kinds.items()]]

    own = nodes.select(*row("low", F.col("depth"), n=F.col("n"), k1=F.col("k1"), k2=F.col("k2"), saved=(F.col("n") - 1) * F.col("bytes")))
    hung = chains.filter("up is not null")
    sums = hung.groupBy("up", (F.col("top") - 1).alias("at")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    branches = sums.select(*row("up", F.col("at"), children=F.col("children"), leaves=F.col("leaves"), saved=F.col("saved")))
    tops = hung.select(*row("m", F.col("top"), parent=F.col("up")))
    ends = sums.select(F.col("up").alias("m"), F.col("at").alias("bottom"), F.lit(1).alias("goes_on"))
    bottoms = chains.join(ends, ["m", "bottom"], "left").select(*row("m", F.col("bottom"), bottom=F.lit(True), leaves=(1 - F.coalesce("goes_on", F.lit(0))).cast("long")))
    rows = own.unionByName(branches).unionByName(tops).unionByName(bottoms).withColumn("block", block)
    long = chains.filter(F.col("bottom") >= BLOCK).select("m")
    blocks = rows.join(long, "m", "left_semi").groupBy("m", "block").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    later = Window.partitionBy("m").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    behind = blocks.select("m", "block", *[F.coalesce(F.sum(x).over(later), zero).alias(x) for x in ("leaves", "saved")])
    behind = behind.select(*row("m", (F.col("block") + 1) * BLOCK, leaves=F.col("leaves"), saved=F.col("saved")), "block")  # stands behind the block's last node
    rows = rows.unionByName(behind).repartition("m", "block")
    at = rows.groupBy("m", "block", "depth").agg(*[F.max(x).alias(x) for x in ("n", "k1", "k2", "parent", "bottom")], *[F.sum(x).alias(x) for x in ("children", "leaves", "saved")])
    below = Window.partitionBy("m", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    at = at.select("*", F.sum("leaves").over(below).alias("n_leaves"), F.sum("saved").over(below).alias("saved_tokens")).filter("n is not null")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "m"))
    return at.select("m", "depth", parent.alias("parent"), "n", (F.col("children") + F.when(F.col("bottom"), 0).otherwise(1)).alias("n_children"), "n_leaves", "saved_tokens", "k1", "k2")


def trie(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows as ``rebuilt`` gives them: all nodes (k1, k2, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens), and the end lists (k1, k2, first, ids)."""
    tries, tasks = partial_tries(rows)
    nodes = scratch(_merged(tries, tasks), "trie-nodes")
    out = _rolled(nodes, _chains(nodes))
    out = out.select("k1", "k2", F.col("m").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    return out, _merged_ends(tries, tasks)


def with_digests(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes with ends_sha256, of the ids that end there, in order and joined by commas."""
    dealt = ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "first", "ids")
    digests = dealt.mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")
    return nodes.join(digests, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).drop("k1", "k2")


def prefix_nodes(conversations: DataFrame, **columns: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations with the digest of its end list."""
    return with_digests(*trie(rebuilt(numbered(conversations, **columns))))
