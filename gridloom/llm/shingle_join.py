"""Components of texts whose sets of five-word shingles have a Jaccard similarity of at least ``likeness``.

A text is the set of hashes of its SHINGLE-word shingles (fewer words: one shingle; no word: one empty
shingle). Equal sets are one node, so copies cost one entry. Candidates come from SimHash alone: each set has WIDTH bits, a bit is that of the majority of its
shingles, and two sets are compared where a table agrees. A table is a choice of bits. Tables of few bits deal the texts to tasks; there each long run is dealt again, in memory, by
tables of further bits, so that runs of about RUN texts are compared. There are so many tables (``tables``) that a pair of just the similarity asked for is compared in none with a probability of at most
MISS; a more similar one with less. Compared are sizes, which must fit the similarity, and SimHashes, which may differ in no more bits than ``radius`` allows. The texts of a key that more than MOST
share are dealt again: by classes of size, of which alike texts are in one or in neighbours, and then by pairs of blocks, so no task gets more than about 2 * MOST of a key.
A long run of candidates gives a spanning forest only. The components of candidates are coarse: their texts are
brought together, and their links found by the exact similarity of the sets. A component of more than CHUNK
texts is dealt to chunks: each finds the links among its own texts and to the component's first text, and then the texts that
the first one's class does not hold meet all other chunks, pair of chunks by pair of chunks. In a large group of near copies
that leaves few; only a component of many texts without a common class costs the square of its size, over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import scratch, slices, text_bytes
from .links import components

SEED = 42
SHINGLE = 5
#: Bits of a SimHash.
WIDTH = 256
#: Bits of a table that deals texts to tasks: so many at least, and so many that about DEALT texts share a key. RUN: texts that share a key of an inner table.
LEAST_BITS, DEALT, RUN = 5, 32_768, 8
#: Bits of a table inside a run at most; the probability that it takes just alike texts that share the run together. MISS: that of their meeting nowhere at all.
INNER_BITS, CAUGHT, MISS = 14, 0.9, 3e-6
#: Sets below FEW shingles: a bit is often a tie, and may differ with a probability of UNSURE (4 of 5 shingles in common).
FEW, UNSURE = 8, 0.1875
#: Texts of a run whose pairs are all told; of longer ones a forest is.
SHORT = 128
#: Texts of one key that a task compares two by two, and that it deals by tables of its own.
CROWD, MOST = 4096, 65_536
#: Rows of a join's smaller side that each executor holds, so that whole texts are not exchanged; beyond, both sides are.
HELD_ROWS = 1_000_000
#: Bits of the bands that ``sketched`` gives.
BAND = 4
MEMO_WORDS = 200_000

#: Texts, and their shingles, of a coarse component that one task verifies.
CHUNK, CHUNK_SHINGLES = 2000, 2_000_000

_ROW = "doc_id long, fp long, h long, size long, wide array<long>"
_KEYED = "key long, fp long, size long, " + ", ".join(f"w{k} long" for k in range(WIDTH // 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_DRAWN = _mix(np.arange(1, SHINGLE + WIDTH // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE, _LANE = _DRAWN[:SHINGLE] | np.uint64(1), _DRAWN[SHINGLE:]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxh64_intdigest(word, SEED)
        return h


def shingles(text: bytes, memo: _Words) -> np.ndarray:
    """The set of shingle hashes, sorted."""
    words = text.lower().split()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    out = np.full(max(1, len(h) - k + 1), len(h) if k < SHINGLE else SHINGLE, np.uint64)
    for j in range(k):
        out += h[j : j + len(out)] * _PLACE[j]
    return np.unique(_mix(out))


def sketch(s: np.ndarray) -> tuple[int, np.ndarray, int]:
    """A digest of the set, its SimHash and its size."""
    ones = np.zeros(WIDTH, np.int64)
    for k in range(0, len(s), 4096):
        x = s[k : k + 4096, None]
        bits = np.unpackbits(_mix(x + _LANE).view(np.uint8).reshape(len(x), WIDTH // 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return xxh64_intdigest(s.tobytes(), SEED), np.packbits(2 * ones > len(s), bitorder="little").view(np.uint64), len(s)


def _lists(flat: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), pa.array(flat.view(np.int64)))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Words()
    for batch in slices(batches):
        if len(memo) > MEMO_WORDS:
            memo.clear()
        found = [sketch(shingles(t, memo)) for t in text_bytes(batch.column(1))]
        fp = np.array([x[0] for x in found], np.uint64).view(np.int64)
        wide = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2), pa.array([x[2] for x in found], pa.int64()), _lists(wide, WIDTH // 64)], names=["doc_id", "fp", "h", "size", "wide"])


def differing(likeness: float) -> float:
    """The probability at most that a bit of the SimHashes of sets this alike differs."""
    return float(np.arccos(min(1.0, 2 * likeness / (1 + likeness))) / np.pi)


def inner_tables(bits: int, p: float) -> int:
    """Tables of so many bits that a run is dealt by."""
    return max(1, math.ceil(math.log(1 - CAUGHT) / math.log1p(-min((1 - p) ** bits, 1 - 1e-12))))


def tables(bits: int, p: float, inner: float | None = None, miss: float = MISS) -> int:
    """How many tables of so many bits it takes that SimHashes whose bits differ with a probability of ``p`` agree in one, but for a probability of ``miss``; and with ``inner`` that they
    also meet inside one of the runs, which are dealt for bits that differ with that probability. All tables choose from the same bits, of which some pairs differ in more than others."""
    h = np.arange(WIDTH + 1)
    choose = np.array([math.lgamma(WIDTH + 1) - math.lgamma(x + 1) - math.lgamma(WIDTH - x + 1) for x in h])
    weight = np.exp(choose + h * math.log(max(p, 1e-12)) + (WIDTH - h) * math.log1p(-p))
    same = 1 - h / WIDTH
    met = same**bits
    if inner is not None:
        met = met * np.min([1 - (1 - same**b) ** inner_tables(b, inner) for b in range(1, INNER_BITS + 1)], axis=0)
    n = 1
    while (weight * (1 - met) ** n).sum() > miss:
        n += 1
    return n


def table_bits(n: int) -> int:
    """Bits of a table that deals ``n`` texts."""
    return min(32, max(LEAST_BITS, math.ceil(math.log2(max(1, n) / DEALT))))


def _table_values(wide: np.ndarray, bits: int, n: int, draw: int = 0) -> np.ndarray:
    """The bits of each SimHash (a row of words) in each of ``n`` tables. Each ``draw`` chooses others."""
    drawn = _mix(np.arange(n * WIDTH, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED + (draw << 40))).reshape(n, WIDTH)
    place = np.argsort(drawn, axis=1)[:, :bits]
    own = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(wide), WIDTH // 8), axis=1, bitorder="little")
    value = np.zeros((len(wide), n), np.uint64)
    for j in range(bits):
        value = (value << np.uint64(1)) | own[:, place[:, j]]
    return value


def table_keys(wide: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The key of each SimHash in each of ``n`` tables."""
    return _mix(_table_values(wide, bits, n) + _mix(np.arange(1, n + 1, dtype=np.uint64)))


def _keyed(bits: int, likeness: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fp, size, wide -> a row for each table: its key, fp, size and the words that are compared. Sets below FEW shingles go to more tables. Sets so small that none but
    an equal one is alike enough have no row."""
    p = differing(likeness)
    all_sets = tables(bits, p, p)
    few = max(all_sets, tables(bits, UNSURE, p)) if likeness < 1 else all_sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            fp, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wide = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, WIDTH // 64)
            may = size >= likeness * (size + 1) - 1e-9
            for small, n in ((False, all_sets), (True, few)):
                at = np.flatnonzero(may & ((size < FEW) == small))
                if len(at):
                    to = np.repeat(at, n)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (table_keys(wide[at], bits, n).ravel(), fp[to], size[to], *(wide[to, k] for k in range(WIDTH // 64)))], names=["key", "fp", "size", *(f"w{k}" for k in range(WIDTH // 64))])

    return run


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of 0 to n - 1. ``near(a, others)`` tells which others link to ``a``; what is reached is not asked for again."""
    out, left = [], np.arange(n)
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            a = reached.pop()
            hit = near(a, left)
            out += [(a, b) for b in left[hit].tolist()]
            reached += left[hit].tolist()
            left = left[~hit]
    return out


def radius(likeness: float, size: np.ndarray) -> np.ndarray:
    """Bits in which SimHashes of sets this alike may differ. A bit differs with a probability of at most arccos(2 l / (1 + l)) / pi; what is allowed is five
    standard deviations above the mean of that, and a little more for sets of a few shingles, whose bits are often ties."""
    p = differing(likeness)
    return np.ceil(WIDTH * p + 5.1 * np.sqrt(WIDTH * p * (1 - p))) + np.where(size < 8, 12, 0)


def _candidates(likeness: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """key, fp, size and the words of the SimHash, all rows of a key in one task -> a long, b long."""
    return lambda batches: _compared(batches, likeness)


def _compared(batches: Iterator[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    key, fp, size = (t.column(c).to_numpy() for c in ("key", "fp", "size"))
    wide = np.stack([t.column(f"w{k}").to_numpy() for k in range(WIDTH // 64)], axis=1).view(np.uint64)
    most = radius(likeness, size)
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    length = n[at]
    _, own = np.unique(fp, return_inverse=True)
    low = np.arange(own.max() + 1)  # of each set the smallest that it links to by way of others
    short = np.flatnonzero(length <= SHORT)
    low = _joined(low, own[short[_close(key[short], size[short], wide[short], most[short], likeness)]])
    long = np.flatnonzero(length > SHORT)
    if len(long):
        p, bits = differing(likeness), np.minimum(INNER_BITS, np.ceil(np.log2(length[long] / RUN))).astype(np.uint64)
        for t in range(max(inner_tables(int(b), p) for b in np.unique(bits))):
            values = _table_values(wide[long], INNER_BITS, 1, 1 + t)[:, 0] & ((np.uint64(1) << bits) - np.uint64(1))
            again = _mix(key[long].view(np.uint64) + _mix(values + np.uint64(1)))
            low = _joined(low, own[long[_close(again, size[long], wide[long], most[long], likeness)]])
    ids = np.unique(fp)
    a = np.flatnonzero(low != np.arange(len(low)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[low[a]])], names=["a", "b"])


def _joined(low: np.ndarray, links: np.ndarray) -> np.ndarray:
    """``low``, the smallest member of the component of each of 0 to n - 1, after further ``links`` (a pair a row)."""
    a, b = links.T
    while len(a):
        x, y = low[a], low[b]
        a, b = a[x != y], b[x != y]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    return low


def _close(key: np.ndarray, size: np.ndarray, wide: np.ndarray, most: np.ndarray, likeness: float) -> np.ndarray:
    """Pairs of places of one key whose sizes and SimHashes fit: all of a short run, of a longer one a forest."""
    by = np.lexsort((size, key))
    key, wide, size, most = key[by], wide[by], size[by], most[by]
    edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
    length = np.diff(edges)
    found = [np.zeros((0, 2), np.int64)]
    for start, stop in zip(edges[:-1][length > SHORT].tolist(), edges[1:][length > SHORT].tolist(), strict=True):
        own, large, far = wide[start:stop], size[start:stop], most[start:stop]

        def near(a: int, others: np.ndarray, own=own, large=large, far=far) -> np.ndarray:
            hit = np.minimum(large[others], large[a]) >= likeness * np.maximum(large[others], large[a])
            some = others[hit]
            hit[hit] = np.bitwise_count(own[some] ^ own[a]).sum(axis=1, dtype=np.int32) <= np.maximum(far[some], far[a])
            return hit

        found.append(np.array(_forest(stop - start, near), np.int64).reshape(-1, 2) + start)
    last = np.repeat(np.where(length <= SHORT, edges[1:], 0), length)  # of each text in a short run the run's end
    at = np.arange(len(key))
    for shift in range(1, SHORT):
        at = at[at + shift < last[at]]
        a = at = at[size[at] >= likeness * size[at + shift]]  # a run's sizes ascend
        if not len(at):
            break
        far = np.zeros(len(a), np.int32)
        for k in range(WIDTH // 64):
            far += np.bitwise_count(wide[a, k] ^ wide[a + shift, k])
        a = a[far <= np.maximum(most[a], most[a + shift])]
        found.append(np.stack([a, a + shift], axis=1))
    return by[np.concatenate(found)]


class _Sets:
    """The sets of some texts, each fp once, and which are alike."""

    def __init__(self, table: pa.Table, likeness: float):
        memo, sets = _Words(), {}
        for batch in table.select(["fp", "text"]).to_batches():
            for fp, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                if fp not in sets:
                    sets[fp] = shingles(text, memo)
        self.fps, self.likeness = sorted(sets), likeness
        self.own = [sets[f] for f in self.fps]
        self.size = np.array([len(x) for x in self.own])

    def near(self, a: int, others: np.ndarray) -> np.ndarray:
        own, size = self.own, self.size
        fits = np.minimum(size[others], size[a]) >= self.likeness * np.maximum(size[others], size[a])
        hit, some = np.zeros(len(others), bool), others[fits]
        if len(some):
            flat = np.concatenate([own[b] for b in some.tolist()])
            at = np.minimum(np.searchsorted(own[a], flat), size[a] - 1)
            both = np.add.reduceat((own[a][at] == flat).astype(np.int64), np.cumsum(size[some]) - size[some])
            hit[fits] = both >= self.likeness * (size[some] + size[a] - both)
        return hit


def _verified(likeness: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """The texts of a chunk and its component's first text -> fp and class, the first fp that it links to by way of others."""
        sets, of = _Sets(table, likeness), {}
        for a, b in _forest(len(sets.fps), sets.near):  # a link's first end is reached before its second
            of[b] = of.setdefault(a, a)
        out = [(f, sets.fps[of.get(k, k)]) for k, f in enumerate(sets.fps)]
        return pa.table({"root": pa.array([table["root"][0].as_py()] * len(out), pa.int64()), "fp": pa.array([f for f, _ in out], pa.int64()), "class": pa.array([c for _, c in out], pa.int64())})

    return run


def _met(likeness: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """A chunk's texts and texts of other classes (``stray``) -> links between classes, each once."""
        sets = _Sets(table, likeness)
        at = {f: k for k, f in enumerate(sets.fps)}
        classes = np.zeros(len(sets.fps), np.int64)
        strays, members = set(), set()
        for f, c, s in zip(*(table[x].to_pylist() for x in ("fp", "class", "stray")), strict=True):
            classes[at[f]] = c
            (strays if s else members).add(at[f])
        found: set[tuple[int, int]] = set()
        members = np.array(sorted(members), np.int64)
        for a in sorted(strays):
            c = int(classes[a])
            left = members[(classes[members] != c) & ~np.isin(classes[members], [y if x == c else x for x, y in found if c in (x, y)])]
            for b in left[sets.near(a, left)].tolist() if len(left) else []:
                found.add((min(c, int(classes[b])), max(c, int(classes[b]))))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the digest of the set), h (a hash of the text), size, wide (the SimHash) and bands (its parts of BAND bits, numbered and hashed) of every row."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("h"))
    bands = [F.xxhash64(F.lit(k), F.shiftright(F.col("wide")[k * BAND // 64], k * BAND % 64).bitwiseAND((1 << BAND) - 1)) for k in range(WIDTH // BAND)]
    return slim.mapInArrow(_sketched, _ROW).withColumn("bands", F.array(*bands))


def dealt(spread: DataFrame, likeness: float, most: int | None = None) -> DataFrame:
    """``spread``: key, fp, size and others; rows of one key are to be compared. The same with no key of many more than ``most`` rows (else CROWD)."""
    most = most or CROWD
    crowded = scratch(spread.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key"), "crowded-bands")
    if crowded.isEmpty():
        return spread
    others = [c for c in spread.columns if c != "key"]
    own = F.floor(F.log("size") / max(-math.log(likeness), 1e-9)).cast("long")
    by_size = spread.join(crowded, "key").select("key", F.explode(F.array(own, own + 1)).alias("__class"), *others).select(F.xxhash64("key", "__class").alias("key"), *others)
    still = scratch(by_size.groupBy("key").agg(F.ceil(F.count("*") / most).alias("__blocks")).filter("__blocks > 1"), "crowded-sizes")
    block = F.pmod(F.xxhash64("fp", F.lit(7)), "__blocks")
    pairs = by_size.join(still, "key").withColumn("__own", block).select("key", "__own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("__with"), *others)
    pairs = pairs.select(F.xxhash64("key", F.least("__own", "__with"), F.greatest("__own", "__with")).alias("key"), *others)
    return spread.join(crowded, "key", "left_anti").unionByName(by_size.join(still, "key", "left_anti")).unionByName(pairs)


def small_side(side: DataFrame, n: int) -> DataFrame:
    """``side``, of ``n`` short rows, for a join with texts."""
    return F.broadcast(side) if n <= HELD_ROWS else side


def roots(nodes: DataFrame, n: int, docs: DataFrame, likeness: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``nodes``: fp, low (unknown, doc_id and h of a row of ``docs`` that has it), size, wide; ``n`` of them. Returns fp and root for every fp that links to another one."""
    bits = table_bits(n)
    rows = n * tables(bits, differing(likeness), differing(likeness))
    spread = nodes.select("fp", "size", "wide").repartition(max(12, rows // 2_000_000)).mapInArrow(_keyed(bits, likeness), _KEYED)
    links = dealt(spread, likeness, min(MOST, 16 * CROWD)).repartition(max(12, rows // 400_000), "key").mapInArrow(_candidates(likeness), "a long, b long")
    coarse = scratch(components(scratch(links.distinct(), "candidates")).join(nodes.select("fp", "low", "size"), "fp"), "coarse")
    parts = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / CHUNK_SHINGLES)).cast("int")
    split = coarse.groupBy("root").agg(parts.alias("chunks"))
    lows = coarse.join(split, "root").select("fp", "root", "chunks", F.pmod(F.xxhash64("fp"), "chunks").cast("int").alias("chunk"), F.col("low.doc_id").alias("__low"), F.col("low.h").alias("__h"))
    texts = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("__own"))
    met = texts.join(small_side(lows, coarse.count()), texts["__id"].eqNullSafe(F.col("__low")) & (F.col("__own") == F.col("__h"))).select("root", "chunk", "chunks", "fp", "text")
    many = split.filter("chunks > 1")
    if many.isEmpty():
        return met.groupBy("root").applyInArrow(_verified(likeness), "root long, fp long, class long").select("fp", F.col("class").alias("root"))
    met = scratch(met, "candidate-texts")  # a component's first text, the smallest fp, names it and goes to all its chunks
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    first = met.filter("chunks > 1 and fp = root").select("root", F.explode(every).alias("chunk"), "fp", "text")
    classes = scratch(met.select("root", "chunk", "fp", "text").unionByName(first).groupBy("root", "chunk").applyInArrow(_verified(likeness), "root long, fp long, class long").distinct(), "classes")
    held = met.filter("chunks > 1").join(classes.select("fp", "class"), "fp")
    strays = held.filter("class <> root").select("root", F.pmod(F.xxhash64("fp", F.lit(1)), "chunks").cast("int").alias("stray_chunk"), "chunks", "fp", "class", "text")
    few = strays.select("root", "stray_chunk").distinct()
    sides = strays.select("root", F.explode(every).alias("chunk"), "stray_chunk", "fp", "class", "text", F.lit(True).alias("stray"))
    sides = sides.unionByName(held.join(few, "root").select("root", "chunk", "stray_chunk", "fp", "class", "text", F.lit(False).alias("stray")))
    between = sides.groupBy("root", "chunk", "stray_chunk").applyInArrow(_met(likeness), "a long, b long")
    edges = classes.filter("fp <> class").select(F.col("fp").alias("a"), F.col("class").alias("b")).unionByName(between)
    return components(edges)
