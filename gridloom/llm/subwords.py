"""Hashed subword features whose weights add up, so a text is scored by its distinct words.

A word stands between two spaces; its features are the hashes of its character n-grams (the
spaces included) and, where asked for, of the whole word; a word equal to the one before it gives
the bucket ``same``, which stands for all such word pairs. A linear score of a text's mean feature
vector is the sum of its words' sums over the sum of their feature counts; each task computes
those sums once for a distinct word and then looks them up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Distinct words, and their bytes, that a task remembers before it starts afresh.
MEMO_WORDS, MEMO_BYTES = 250_000, 8 << 20
#: Words of a text that are added up at a time.
PIECE = 1 << 18


def word_features(words: list[bytes], sizes: tuple[int, ...], bits: int, whole: bool, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of every feature of ``words``; buckets lie below ``2**bits``."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = (b" " + b" ".join(words) + b" ").decode("utf-8")
    cp = np.frombuffer((text.lower() if fold else text).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    space = cp == 32
    number = np.cumsum(space) - 1  # the word that starts after the last space
    gaps = np.flatnonzero(space)
    shift = np.uint64(64 - bits)
    owners, buckets = [], []
    for n in sizes:
        m = len(cp) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(0xCBF29CE484222325 ^ n))
        for j in range(n):
            h = (h ^ cp[j : m + j]) * _PRIME
        inside = number[n - 1 : m + n - 1] - number[:m]
        ends = space[n - 1 : m + n - 1]
        ok = (inside == 0) | ((inside == 1) & ends)  # at most the word's own two spaces
        if n == 1:
            ok = ~space[:m]
        at = np.flatnonzero(ok & (number[:m] < len(words)))
        owners.append(number[at])
        buckets.append(((h[at] * _MIX) >> shift).astype(np.int64))
    if whole:
        at = np.arange(len(cp), dtype=np.uint64)
        starts, ends = gaps[:-1] + 1, gaps[1:]
        place = at - (gaps[number] + 1).astype(np.uint64)
        term = (cp + np.uint64(1)) * ((place * _MIX) | np.uint64(1)) * _PRIME
        term ^= term >> np.uint64(29)
        term[space] = 0
        sums = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
        h = sums[ends] - sums[starts] + np.uint64(977)
        owners.append(np.arange(len(words)))
        buckets.append(((h * _MIX) >> shift).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def bag_of(counts: Counter, sizes: tuple[int, ...], bits: int, whole: bool, fold: bool, extra: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, given by the counts of its words, and their shares. ``extra``: counts of buckets besides."""
    owner, bucket = word_features(list(counts), sizes, bits, whole, fold)
    n = np.array(list(counts.values()), float)[owner] if len(owner) else np.zeros(0)
    for k, v in (extra or {}).items():
        bucket, n = np.append(bucket, k), np.append(n, v)
    ids, at = np.unique(bucket, return_inverse=True)
    share = np.bincount(at, weights=n, minlength=len(ids)) if len(ids) else np.zeros(0)
    return ids, share / max(share.sum(), 1)


def _bags(make: Callable[[bytes], tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple[int, bytes]] = {}
        for batch in slices(batches, 64):
            for i, label, h, text in zip(*(c.to_pylist() for c in batch.columns[:3]), text_bytes(batch.column(3)), strict=True):
                if (i, label) not in best or h < best[i, label][0]:
                    ids, share = make(text)
                    best[i, label] = h, ids.astype("<i4").tobytes() + share.astype("<f4").tobytes()
        rows = [(*k, *v) for k, v in best.items()]
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "label", "h", "bag"])

    return run


def collected_bags(rows: DataFrame, make: Callable[[bytes], tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Bags and labels of a bounded sample of doc_id, label and text, whole texts. The bags are made in the tasks, so the driver gets at most
    2**bits numbers a row, however long texts are; of several texts of one id and label it gets the one with the smallest hash."""
    slim = rows.select("doc_id", F.col("label").cast("string").alias("label"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), "text")
    bags = slim.mapInArrow(_bags(make), "doc_id long, label string, h long, bag binary")
    found = bags.groupBy("doc_id", "label").agg(F.min_by("bag", "h").alias("bag")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["label"]))
    split = lambda raw: (np.frombuffer(raw, "<i4", len(raw) // 8).astype(np.int64), np.frombuffer(raw, "<f4", len(raw) // 8, len(raw) // 2).astype(float))
    return [split(r["bag"]) for r in found], [r["label"] for r in found]


class _Ids(dict):
    """Gives each new word the next number and keeps it for the next computation."""

    def __init__(self):
        self.new: list[bytes] = []
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        self.bytes += len(word)
        return n


class WordSums:
    """Sums of feature weights by word. ``weights``: one row for each linear score."""

    def __init__(self, weights: np.ndarray, sizes: tuple[int, ...], bits: int, whole: bool, fold: bool, skip: Callable[[bytes], bool] | None = None, same: int | None = None):
        self.weights, self.sizes, self.bits, self.whole, self.fold, self.skip, self.same = weights, sizes, bits, whole, fold, skip, same
        self._reset()

    def _reset(self) -> None:
        self.ids, self.sums, self.count = _Ids(), np.zeros((len(self.weights), 0)), np.zeros(0)

    def _learn(self) -> None:
        words, self.ids.new = self.ids.new, []
        owner, bucket = word_features(words, self.sizes, self.bits, self.whole, self.fold)
        count = np.bincount(owner, minlength=len(words)).astype(float)
        sums = np.array([np.bincount(owner, weights=w[bucket], minlength=len(words)) for w in self.weights])
        if self.skip:
            keep = np.array([not self.skip(w) for w in words], dtype=float)
            count, sums = count * keep, sums * keep
        self.sums = np.concatenate([self.sums, sums], axis=1)
        self.count = np.concatenate([self.count, count])

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the summed weights (a row for each score) and the number of features."""
        if len(self.ids) > MEMO_WORDS or self.ids.bytes > MEMO_BYTES:
            self._reset()
        number = self.ids.__getitem__
        numbers = []
        for text in texts:
            words = text.split()
            numbers.append(np.fromiter(map(number, words), np.int32, len(words)))
        if self.ids.new:
            self._learn()
        sums, count = np.zeros((len(self.weights), len(texts))), np.zeros(len(texts))
        for i, own in enumerate(numbers):
            for k in range(0, len(own), PIECE):
                at = own[k : k + PIECE]
                sums[:, i] += self.sums[:, at].sum(axis=1)
                count[i] += self.count[at].sum()
            if self.same is not None:
                repeats = np.count_nonzero(own[1:] == own[:-1])
                sums[:, i] += repeats * self.weights[:, self.same]
                count[i] += repeats
        return sums, count
