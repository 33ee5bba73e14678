"""SimHash near-duplicates with pivot distance tables.

Fingerprint: 64 bits; a bit is set if it is set in over half of the XXH64 hashes (seed 42) of a
text's 3-word shingles, repeats included. Two fingerprints link at ``RADIUS`` or fewer differing
bits; components of links are found over distinct fingerprints, so copies cost one entry.

Every fingerprint gets a table of its Hamming distances to ``PIVOTS`` reference fingerprints. By
the triangle inequality two fingerprints that link differ by at most RADIUS in each
coordinate: pairs with a larger maximum coordinate difference are discarded, survivors are verified
on the bits. As distances of 64-bit fingerprints crowd around 32, coordinates alone can't
deal pairs to tasks. What is dealt are bands: of BANDS bands at least ``BANDS - RADIUS`` agree
in a linked pair, so the pair meets under some choice of agreeing bands; no link is lost. Inside a
task, a band's run is sorted by its first coordinate, and only neighbours within RADIUS there
are compared. Each run gives links from its members to their run's components only, never all pairs.

Defined results: null or empty text has fingerprint 0 and links like any other. A null doc_id is
not a component's smallest unless the component has no other. Repeated rows are returned as often
as given. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import shingle_join
from .common import scratch, slices, text_bytes
from .links import components

SEED = 42
RADIUS = 3
SHINGLE = 3
PIVOTS = 24
#: Fingerprints of one key that a task compares; the bands by which those of a larger key are dealt again.
HOT_RUN, FINE_BANDS = 8192, 7


def fingerprint(text: bytes) -> int:
    """The SimHash of a text in UTF-8; the bits of all shingles are summed in pieces of bounded size."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k : k + 65_536], stops[k : k + 65_536], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        fp = np.array([fingerprint(t) for t in text_bytes(batch.column(1))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], names=["doc_id", "fp", "h"])


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and h (a hash of the text) of every row."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("h"))
    return slim.mapInArrow(_fingerprints, "doc_id long, fp long, h long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: the hashes of 0, 1, 2 and so on."""
    return np.array([xxh64_intdigest(b"%d" % k, SEED) for k in range(n)], dtype=np.uint64)


def pivot_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances, a row for each fingerprint."""
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def _band_masks(bands: int) -> list[int]:
    """Masks of the bits that agree: each choice of ``bands - RADIUS`` of ``bands`` bands."""
    edge = [round(64 * k / bands) for k in range(bands + 1)]
    own = [(1 << edge[k + 1]) - (1 << edge[k]) for k in range(bands)]
    return [sum(c) for c in combinations(own, bands - RADIUS)]


def run_links(fp: np.ndarray, refs: np.ndarray, most: int = 1024) -> list[tuple[int, int]]:
    """Links that join the components of distinct fingerprints of one run; at most one less than there are fingerprints.

    Runs above ``most`` are dealt again by bands of their own, so that a run of near copies isn't compared pair by pair."""
    table = pivot_table(fp, refs)
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    root = np.arange(len(fp))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []

    def join(a: int, b: int) -> None:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            links.append((int(fp[a]), int(fp[b])))

    def compare(rows: np.ndarray) -> None:
        for k, a in enumerate(rows[:-1]):
            others = rows[k + 1 :]
            others = others[: np.searchsorted(table[others, 0], table[a, 0] + RADIUS, side="right")]
            others = others[np.abs(table[others] - table[a]).max(axis=1) <= RADIUS] if len(others) else others
            for b in others[np.bitwise_count(fp[others] ^ fp[a]) <= RADIUS].tolist():
                join(int(a), b)

    if len(fp) <= most:
        compare(np.arange(len(fp)))
        return links
    for mask in _band_masks(FINE_BANDS):
        key = fp & np.uint64(mask)
        by = np.lexsort((table[:, 0], key))
        for rows in np.split(by, np.flatnonzero(np.diff(key[by])) + 1):
            if len(rows) > 1:
                compare(rows)
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key long, fp long, all of a key in one task -> a long, b long."""
    refs = pivots()
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
    fp = fp.view(np.uint64)
    first = np.bitwise_count(fp ^ refs[0])
    by = np.lexsort((first, key))
    own, key, first = fp[by], key[by], first[by]
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.append(edges, len(key)))
    pairs = []
    for start, n in zip(edges[length > 64].tolist(), length[length > 64].tolist(), strict=True):
        pairs += run_links(own[start : start + n], refs)
    small = np.repeat(length <= 64, length)
    for shift in range(1, min(64, int(length.max(initial=1)))):
        a = np.flatnonzero(small[:-shift] & (key[shift:] == key[:-shift]))
        if not len(a):
            break
        a = a[first[a + shift] <= first[a] + RADIUS]
        for k in range(0, len(a), 1 << 17):
            x, y = own[a[k : k + (1 << 17)]], own[a[k : k + (1 << 17)] + shift]
            far = np.abs(pivot_table(x, refs) - pivot_table(y, refs)).max(axis=1) if len(x) else np.zeros(0)
            hit = (far <= RADIUS) & (np.bitwise_count(x ^ y) <= RADIUS)
            pairs += zip(x[hit].tolist(), y[hit].tolist(), strict=True)
    a, b = (np.array(v, dtype=np.uint64).view(np.int64) for v in (zip(*pairs, strict=True) if pairs else ((), ())))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _banded(rows: DataFrame, bands: int, *kept: str) -> DataFrame:
    """Each row once for each choice of agreeing bands: ``key`` of those bits, and of the old columns ``kept``."""
    bits = [F.col("fp").bitwiseAND(F.lit(int(np.uint64(m).view(np.int64)))) for m in _band_masks(bands)]
    keys = F.array(*[F.xxhash64(F.lit(k), b, *kept) for k, b in enumerate(bits)])
    return rows.select(F.explode(keys).alias("key"), "fp")


def fingerprint_components(fps: DataFrame, n: int, hot: int = HOT_RUN) -> DataFrame:
    """``fps``: distinct fp. Returns fp and root for every fingerprint that links to another one.

    Of a key that more than ``hot`` fingerprints share, the fingerprints are dealt again over all tasks by finer bands."""
    bands = 4 if n < 1 << 22 else 5 if n < 1 << 28 else 6  # lossless at any number; more bands make shorter runs
    spread = _banded(fps, bands)
    crowded = scratch(spread.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key"), "crowded-bands")
    dealt = spread
    if not crowded.isEmpty():
        again = _banded(spread.join(crowded, "key"), FINE_BANDS, "key")
        dealt = spread.join(crowded, "key", "left_anti").unionByName(again)
    tasks = max(12, n * len(_band_masks(bands)) // 400_000)
    links = dealt.repartition(tasks, "key").mapInArrow(_links, "a long, b long")
    return components(scratch(links.distinct(), "links"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", likeness: float | None = 0.8) -> DataFrame:
    """Every row as doc_id, fp, h, component_id (the smallest doc_id reachable by links) and keep_h (that row's h, the smallest of several).

    Links are those of texts whose sets of five-word shingles have a Jaccard similarity of at least ``likeness``, as in the pipeline; fp then names the set.
    With None they are those of fingerprints, op10's rule."""
    own = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h")
    if likeness is None:
        rows = scratch(fingerprinted(docs, doc_id, text), "fingerprints")
        by_fp = scratch(rows.groupBy("fp").agg(F.min(own).alias("low")), "distinct-fingerprints")
        roots = fingerprint_components(by_fp.select("fp"), by_fp.count())
    else:
        rows = scratch(shingle_join.sketched(docs, doc_id, text).drop("bands"), "sketches")
        by_fp = scratch(rows.groupBy("fp").agg(F.min(own).alias("low"), F.first("size").alias("size"), F.first("wide").alias("wide")), "distinct-sketches")
        roots = scratch(shingle_join.roots(by_fp, by_fp.count(), docs, likeness, doc_id, text), "roots")
    known = by_fp.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lows = known.groupBy("root").agg(F.min("low").alias("low"))
    named = known.select("fp", "root").join(lows, "root").select("fp", F.col("low.doc_id").alias("component_id"), F.col("low.h").alias("keep_h"))
    return rows.join(named, "fp").select("doc_id", "fp", "h", "component_id", "keep_h")


def near_documents(docs: DataFrame) -> DataFrame:
    out = near_groups(docs, likeness=None)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", likeness: float | None = 0.8) -> DataFrame:
    """The rows of ``docs``, whole, of which each group of near copies keeps its smallest doc_id; rows equal in id and text stay together."""
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("h") == F.col("keep_h"))
    dropped = scratch(near_groups(docs, doc_id, text, likeness).filter(~stays).select(F.col("doc_id").alias("__dropped"), F.col("h").alias("__h")).distinct(), "dropped")
    dropped = shingle_join.small_side(dropped, dropped.count())
    return docs.join(dropped, docs[doc_id].cast("long").eqNullSafe(F.col("__dropped")) & (F.xxhash64(docs[text]) == F.col("__h")), "left_anti")
