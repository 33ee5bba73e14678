"""Maximal periodic runs of words, from branching tandem repeats found on a suffix tree.

A tandem repeat is a stretch ``ww``; it branches if the word behind it is not the one that would carry the repetition on.
Each maximal run of period q ends with just one branching repeat of 2q words. After Stoye and Gusfield:

* The suffix tree is held as the intervals of a suffix array and its longest common prefixes (``_Suffixes``, ``_tree``).
* For a node of depth d, a leaf i and a leaf i + d below it make a repeat, which branches if their next words differ. Only leaves
  outside a node's largest child are asked, forwards and backwards: each leaf is asked once for every light edge above it, of which there
  are at most log2 n (``_branching``).
* A branching repeat is rotated to the left as far as it goes, found by halving over common prefixes, and
  repeats of one stretch are merged under the smallest period (``_runs``).

Texts of a batch share one tree; their words are told apart by their stretch. What cannot lie in a run long enough is left out beforehand: of
each three words in a row of a run some number of copies stands in the run as well (``_copies``), so words without so many
never reach the tree.

Memory: 5 bytes a word, and about 200 bytes for each word that stands in a stretch with enough copies; a text is worked on whole.

Defined results: null text and text of white space have no words and no runs. Null ids and repeated rows are answered like others.
No rows: no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
BATCH_BYTES = 8 << 20
SLICE = 1 << 20

#: For a document of ``n`` words: which of its own words stands at each place; None: each stays.
Order = Callable[[int | None, int], np.ndarray | None]


def _copies(length: int, exponent: int) -> int:
    """So many copies of any three neighbouring words of a run, at least, lie in the run, if it has ``length`` words and ``exponent`` periods at least."""
    return min([max(exponent - 1, 0), *((max(length, exponent * q) - 2) // q for q in range(1, max(length, 3) + 1))])


def _triples(words: np.ndarray, begin: int, end: int, seed: int, bits: int) -> np.ndarray:
    """A hash of each word in [begin, end) and the two behind it."""
    x = words[begin : end + 2].astype(np.uint64)
    h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)) ^ np.uint64(seed)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def _candidates(words: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """True for each word that is one of three in a row of which the text has ``least`` copies; sometimes for others too, as copies are counted by hash.

    ``text``: the first word of each text, and the end."""
    n = len(words)
    if least < 2:
        return np.ones(n, bool)
    bits = int(np.clip((4 * n).bit_length(), 12, 26))
    on = np.zeros(n, bool)
    on[: max(n - 2, 0)] = True
    for back in (1, 2):  # three in a row lie in one text
        on[np.maximum(text[1:] - back, 0)[np.diff(text) >= back]] = False
    for seed in (0x51ED2701, 0x7F4A7C15):
        number = np.zeros(1 << bits, np.int32)
        spans = [(b, min(b + SLICE, n - 2)) for b in range(0, max(n - 2, 0), SLICE)]
        for count in (True, False):
            for b, e in spans:
                at = b + np.flatnonzero(on[b:e])
                own = np.searchsorted(text, at, side="right")
                h = _triples(words, b, e, seed, bits)[at - b] ^ (own * 0x9E3779B1 & ((1 << bits) - 1))
                if count:
                    number += np.bincount(h, minlength=1 << bits).astype(np.int32)
                else:
                    on[at] = number[h] >= least
    covered = on.copy()
    for back in (1, 2):
        covered[back:] |= on[:-back]
    return covered


class _Suffixes:
    """Suffixes of a row of numbers in order, by doubling, and common prefixes. Each stretch ends with a number of its own."""

    def __init__(self, row: np.ndarray):
        n = len(row)
        order = np.argsort(row, kind="stable")
        head = np.ones(n + 1, bool)
        head[1:n] = row[order[1:]] != row[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
        self.levels = [rank.astype(np.int32)]
        step = 1
        while len(at := np.flatnonzero(~(head[:n] & head[1:]))):  # places of suffixes not yet told apart
            start = order[at]
            key = rank[start] * n + rank[start + step]
            way = np.argsort(key, kind="stable")
            order[at], key = start[way], key[way]
            head[at[1:]] |= key[1:] != key[:-1]
            rank[order[at]] = np.maximum.accumulate(np.where(head[at], at, 0))
            self.levels.append(rank.astype(np.int32))
            step *= 2
        self.order, self.rank, self.row = order, rank, row

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j <> i begin with in common."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            same = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i, j, out = i + same, j + same, out + same
        return out


def _smaller(height: np.ndarray, step: int) -> np.ndarray:
    """For each place with a height above 0 the nearest lower one in the direction of ``step``, by jumps over what is known to be no lower."""
    to = np.arange(len(height)) + step
    at = np.flatnonzero(height > 0)
    while len(at):
        at = at[height[to[at]] >= height[at]]
        to[at] = to[to[at]]
    return to


def _tree(s: _Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes other than the root: depth, first and last leaf; and for leaves, then nodes, the parent's number (-1: the root)."""
    n = len(s.order)
    height = np.zeros(n + 1, np.int64)
    height[1:n] = s.common(s.order[:-1], s.order[1:])
    height[0] = height[n] = -1
    low, high = _smaller(height, -1), _smaller(height, 1)
    at = np.flatnonzero(height > 0)
    _, first, node = np.unique(low[at] * (n + 1) + high[at], return_index=True, return_inverse=True)
    number = np.full(n + 1, -1)
    number[at] = node
    left, right = low[at[first]], high[at[first]]

    def above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        deeper = np.where(height[a] >= height[b], a, b)
        return number[deeper]

    leaves = np.arange(n)
    return height[at[first]], left, right - 1, np.concatenate([above(leaves, leaves + 1), above(left, right)])


def _branching(s: _Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Place and half length of all branching tandem repeats."""
    depth, left, right, parent = _tree(s)
    n, m = len(s.order), len(depth)
    size = np.concatenate([np.ones(n, np.int64), right - left + 1])
    below = np.flatnonzero(parent >= 0)
    below = below[np.argsort(size[below], kind="stable")]
    largest = np.full(m, -1)
    largest[parent[below]] = below  # the last stays
    up = np.arange(n + m)
    heavy = below[largest[parent[below]] == below]
    up[heavy] = n + parent[heavy]
    while not np.array_equal(up, further := up[up]):  # to the top of the path of largest children
        up = further
    place, half = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    leaf = np.arange(n)
    node = parent[up[leaf]]
    while len(on := np.flatnonzero(node >= 0)):
        leaf, node = leaf[on], node[on]
        i, d, a, b = s.order[leaf], depth[node], left[node], right[node]
        for first, asked in ((i, i + d), (i - d, i - d)):
            there = np.flatnonzero((asked >= 0) & (asked < n))
            rank = s.rank[asked[there]]
            there = there[(rank >= a[there]) & (rank <= b[there])]
            x, q = first[there], d[there]
            ends = s.row[x + q] != s.row[x + 2 * q]
            place.append(x[ends])
            half.append(q[ends])
        node = parent[up[n + node]]
    return np.concatenate(place), np.concatenate(half)


def _runs(row: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all maximal runs of two periods or more. ``begin``: the first place of each stretch of ``row``."""
    s = _Suffixes(row)
    i, q = _branching(s)
    low, high = begin[np.searchsorted(begin, i, side="right") - 1], i
    while (low < high).any():  # the furthest rotation: from there to the repeat's end all words equal those q behind them
        middle = (low + high) // 2
        open_ = low < high
        reaches = s.common(middle, middle + q) >= i + q - middle
        high = np.where(open_ & reaches, middle, high)
        low = np.where(open_ & ~reaches, middle + 1, low)
    end = i + 2 * q
    way = np.lexsort((q, end, low))
    low, end, q = low[way], end[way], q[way]
    first = np.ones(len(q), bool)
    first[1:] = (low[1:] != low[:-1]) | (end[1:] != end[:-1])
    return low[first], end[first], q[first]


def runs(words: np.ndarray, text: np.ndarray, length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of the maximal runs of at least ``length`` words and ``exponent`` (2 or more) periods, by text, start and period.

    ``words``: the words of all texts as numbers. ``text``: the first word of each text, and the end."""
    on = _candidates(words, text, _copies(length, exponent))
    edge = np.zeros(len(words) + 1, bool)
    edge[text] = True
    opens = np.flatnonzero(on & (edge[:-1] | ~np.concatenate([[False], on[:-1]])))
    closes = 1 + np.flatnonzero(on & (edge[1:] | ~np.concatenate([on[1:], [False]])))
    long = closes - opens >= max(length, 2)
    opens, closes = opens[long], closes[long]
    if not len(opens):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    size = closes - opens
    begin = np.cumsum(size + 1) - size - 1
    stretch = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(len(stretch)) - begin[stretch] + opens[stretch]
    last = begin + size
    place[last] = 0
    _, row = np.unique(stretch * (int(words.max()) + 1) + words[place], return_inverse=True)
    row[last] = len(row) + np.arange(len(last))
    start, end, period = _runs(row, begin)
    keep = end - start >= np.maximum(length, exponent * period)
    start, end, period = start[keep], end[keep], period[keep]
    own = np.searchsorted(begin, start, side="right") - 1
    first = start - begin[own] + opens[own]
    number = np.searchsorted(text, first, side="right") - 1
    way = np.lexsort((period, first, number))
    return number[way], (first - text[number])[way], (end - start)[way], period[way]


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, each word's place among them, and the first word of each text with the end behind them."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten().dictionary_encode()
    at, ends = flat.indices.to_numpy(), split.offsets.to_numpy() - split.offsets[0].as_py()
    empty = pc.index(flat.dictionary, "").as_py()
    if empty >= 0:  # white space at the ends leaves empty parts
        full = at != empty
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        at = at[full]
    return flat.dictionary, at, ends


def _largest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[int, int, int]:
    """The run of greatest exponent; of equal ones the first, and of those the one of smallest period."""
    best = None
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        if best is None or n * best[2] > best[1] * q:  # they come by start and period
            best = (s, n, q)
    return best


def _answer(ids: list[int | None], texts: pa.Array, length: int, exponent: int, order: Order | None) -> list[tuple]:
    distinct, at, ends = cut_words(texts)
    moved = set()
    if order:
        at = at.copy()
        for k, i in enumerate(ids):
            places = order(i, int(ends[k + 1] - ends[k]))
            if places is not None:
                moved.add(k)
                at[ends[k] : ends[k + 1]] = at[ends[k] : ends[k + 1]][places]
    own, start, size, period = runs(at, ends, length, exponent)
    bounds = np.searchsorted(own, np.arange(len(ids) + 1))
    out = []
    for k, i in enumerate(ids):
        a, b = bounds[k], bounds[k + 1]
        if a == b and k not in moved:
            kept = b" ".join(texts[k].as_py().encode().split())
        else:
            n = ends[k + 1] - ends[k]
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, start[a:b] + period[a:b], 1)
            np.add.at(change, start[a:b] + size[a:b], -1)
            words = distinct.take(pa.array(at[ends[k] : ends[k + 1]][np.cumsum(change[:-1]) == 0]))
            kept = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py().encode() if len(words) else b""
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in zip(start[a:b].tolist(), size[a:b].tolist(), period[a:b].tolist(), strict=True))
        best = _largest(start[a:b], size[a:b], period[a:b]) or (None, None, None)
        share = 1000 * best[1] // best[2] if best[1] else None
        out.append((i, int(b - a), *best, share, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return out


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, order: Order | None = None) -> DataFrame:
    """Every run as doc_id, start, length, period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, BATCH_BYTES):
            _, at, ends = cut_words(pc.fill_null(b.column(1), ""))
            if order:
                at = at.copy()
                for k, i in enumerate(b.column(0).to_pylist()):
                    places = order(i, int(ends[k + 1] - ends[k]))
                    if places is not None:
                        at[ends[k] : ends[k + 1]] = at[ends[k] : ends[k + 1]][places]
            own, *rest = runs(at, ends, length, exponent)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), *map(pa.array, rest)], names=["doc_id", "start", "length", "period"])

    return _rows(docs, doc_id, text).mapInArrow(run, "doc_id long, start long, length long, period long")


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def collapsed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, order: Order | None = None) -> DataFrame:
    """Every row with its number of runs, the run of greatest exponent, and digests of all runs and of the text without the repetitions of any run."""
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, BATCH_BYTES):
            rows = _answer(b.column(0).to_pylist(), pc.fill_null(b.column(1), ""), length, exponent, order)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)

    return _rows(docs, doc_id, text).mapInArrow(run, _SCHEMA)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of words under which every tenth document ends in a repetition; documents without an id stay."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places
