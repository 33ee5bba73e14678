"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents are tokenised; ids are cut into pieces of at most the capacity. Only the number of
pieces of each length matters to the packing, and there are at most ``capacity`` lengths, so the
driver solves a histogram of bounded size however many documents there are:

* Reduction: a bin whose content provably dominates all others with its largest piece is fixed
  for good: a piece with which no other fits, two pieces that fill a bin exactly, and the largest
  partner where no two pieces fit beside it or where two cannot outweigh it.
* The rest is packed best-fit decreasing. Bins of equal content are one entry with a count.

Each piece then takes its place by its number among the pieces of its length. Those numbers come
from counts by block of documents, so that no task sees all pieces of a length.

Defined results: null text counts as empty; an empty text has the end id alone, one piece of
length 1. Repeated rows are packed each. A null doc_id is packed like others. No rows: no rows.
Extra columns are not read.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, scratch

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
BATCH_BYTES = 16 << 20
MEMO_WORDS, MEMO_BYTES = 300_000, 16 << 20

#: (lengths with their numbers in a bin, bins of this kind)
Pattern = tuple[dict[int, int], int]


#: Chunks of these characters are cut into words by _WORD; they are composed already and each has one lower-case character.
_SIMPLE = re.compile("[!-~\xc0-\u012f\u0131-\u0148\u014a-\u017e]+")
#: The tokenizer's own cut, for such characters, and the line ends that separate chunks.
_WORD = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class Chunks:
    """Token ids of texts. A batch's distinct white-space separated chunks are encoded once; the tokenizer never joins over white space.

    Chunks are cut into words as the tokenizer cuts them, and words not yet met go to it many at a time; the
    token that ends a word tells where the next begins. Other chunks, those with one of its added tokens too, go to it whole."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        parsed = json.loads(definition)
        model, added = parsed["model"], parsed.get("added_tokens") or []
        if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("an added token of this tokenizer reaches over white space")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added) or "(?!)", re.IGNORECASE)
        suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(1 + max(model["vocab"].values(), default=0), bool)
        self.ends[[i for t, i in model["vocab"].items() if suffix and t.endswith(suffix)]] = True
        self.by_word = bool(suffix)
        self.words: dict[str, bytes] = {}
        self.bytes = 0

    def forget(self) -> None:
        self.words.clear()
        self.bytes = 0

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        groups = [words[k : k + 64] for k in range(0, len(words), 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(group):
                raw = ids.tobytes()
                self.words.update(zip(group, map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
            else:
                self.words.update(zip(group, self._whole(group), strict=True))

    def _by_words(self, chunks: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of all chunks in one row, and the bytes of each chunk's."""
        if len(self.words) > MEMO_WORDS or self.bytes > MEMO_BYTES:
            self.forget()
        cut = _WORD.findall("\n".join([*chunks, ""]).lower())
        words = set(cut)
        words.discard("\n")
        new = [w for w in words if w not in self.words]
        self.bytes += sum(map(len, new))
        self._learn_words(new)
        self.words["\n"] = b""
        ids = list(map(self.words.__getitem__, cut))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        stops = np.cumsum(size)[size == 0]
        return b"".join(ids), np.diff(stops, prepend=0)

    def encode_chunks(self, chunks: list[str]) -> tuple[bytes, np.ndarray]:
        joined = "".join(chunks)
        if self.by_word and _SIMPLE.fullmatch(joined) and not self.added.search(joined):
            return self._by_words(chunks)
        simple = [bool(self.by_word and _SIMPLE.fullmatch(c)) and not self.added.search(c) for c in chunks]
        parts = self._whole([c for c, s in zip(chunks, simple, strict=True) if not s])
        raw, size = self._by_words([c for c, s in zip(chunks, simple, strict=True) if s]) if any(simple) else (b"", np.zeros(0, np.int64))
        stops = np.cumsum(size).tolist()
        own, other = map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops)), iter(parts)
        ids = [next(own) if s else next(other) for s in simple]
        return b"".join(ids), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit numbers; null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        chunks = split.flatten().dictionary_encode()
        raw, size = self.encode_chunks(chunks.dictionary.to_pylist())
        ids, size = np.frombuffer(raw, "<u4"), (size // 4).astype(np.int32)
        at = chunks.indices.to_numpy()
        start = np.cumsum(size, dtype=np.int32) - size
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = size[at[a:b]]
            stop = np.cumsum(own, dtype=np.int32)
            out.append(ids[np.repeat(start[at[a:b]] - stop + own, own) + np.arange(stop[-1] if len(stop) else 0, dtype=np.int32)])
        return out


_chunks: dict[int, Chunks] = {}


def _pieces(definition: str, capacity: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    closing, name = np.array([end], "<u4"), zlib.crc32(definition.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _chunks:
            _chunks[name] = Chunks(definition)
        _chunks[name].forget()  # what a task remembers goes with it
        for batch in by_bytes(batches, 1, BATCH_BYTES):
            out: list[tuple] = []
            for doc, block, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _chunks[name].encode(batch.column(1)), strict=True):
                raw = np.concatenate([ids, closing]).tobytes()
                out += [(doc, k, at // 4, len(part) // 4, zlib.crc32(part), block) for k, at in enumerate(range(0, len(raw), 4 * capacity)) for part in [raw[at : at + 4 * capacity]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECE_TYPES, strict=True)], names=_PIECE_NAMES)
        _chunks[name].forget()

    return run


_PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "block"]
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the block (scan task) of every piece. The driver reads the tokenizer's file."""
    definition = Path(tokenizer).read_text(encoding="utf-8")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("block"))
    return slim.mapInArrow(_pieces(definition, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long, block int")


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Bins fixed by dominance, and what is left of ``counts`` (pieces by length)."""
    left, fixed = dict(counts), []
    lengths = sorted(left)

    def take(content: dict[int, int], bins: int) -> None:
        fixed.append((content, bins))
        for n, k in content.items():
            left[n] -= k * bins
            if not left[n]:
                del left[n]
                lengths.remove(n)

    for big in sorted(counts, reverse=True):
        if big not in left:
            continue
        room = capacity - big
        if room == big and left[big] > 1:
            take({big: 2}, left[big] // 2)
        elif room in left and room != big:
            take({big: 1, room: 1}, min(left[big], left[room]))
        while big in left:
            small = lengths[0] if (lengths[0] != big or left[big] > 1) else (lengths[1] if len(lengths) > 1 else None)
            if small is None or small > room:
                take({big: 1}, left[big])
                break
            at = bisect.bisect_right(lengths, room) - 1
            best = lengths[at]
            if best == big:  # its own kind is the largest partner
                if left[big] < 2:
                    at -= 1
                    if at < 0:
                        break
                    best = lengths[at]
                else:
                    break
            if _two_weigh_more(left, lengths, big, best, room):
                break
            bins = min(left[big], left[best])
            take({big: 1, best: 1}, bins)
    return fixed, left


def _two_weigh_more(left: dict[int, int], lengths: list[int], big: int, best: int, room: int) -> bool:
    """Whether two or more pieces besides ``big`` may fit in ``room`` and together exceed ``best``, the largest that fits."""
    smallest = [n for n in lengths[:3] for _ in range(min(3, left[n] - (n == big)))][:3]
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return False  # one partner at most: the largest dominates
    if len(smallest) > 2 and sum(smallest) <= room:
        return True  # three may fit: not decided here
    low, high = 0, bisect.bisect_right(lengths, room) - 1
    while low <= high:  # two partners at most: the heaviest pair that fits
        a, b = lengths[low], lengths[high]
        if a + b > room:
            high -= 1
            continue
        if a + b > best and (a != b or left[a] > 1):
            return True
        low += 1
    return False


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over lengths with counts; bins of equal content stay one entry."""
    rooms: list[int] = []  # ascending
    bins: dict[int, list[list]] = {}

    def put(room: int, content: dict[int, int], n: int) -> None:
        if room not in bins:
            bisect.insort(rooms, room)
            bins[room] = []
        bins[room].append([content, n])

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, todo)
                n = todo // each
                put(capacity - each * length, {length: each}, n)
                todo -= n * each
                continue
            room = rooms[at]
            content, n = bins[room].pop()
            each = min(room // length, todo)
            used = min(n, todo // each)
            if n > used:
                bins[room].append([content, n - used])
            put(room - each * length, {**content, length: content.get(length, 0) + each}, used)
            todo -= used * each
            if not bins[room]:
                del bins[room]
                rooms.remove(room)
    return [(content, n) for held in bins.values() for content, n in held]


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """Sequence and offset of the n-th piece of a length, from the packing's patterns."""

    def __init__(self, patterns: list[Pattern]):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        seen: dict[int, int] = {}
        sequence = 0
        for content, bins in patterns:
            offset = 0
            for length, each in content.items():
                runs.setdefault(length, []).append((seen.get(length, 0), each, sequence, offset))
                seen[length] = seen.get(length, 0) + each * bins
                offset += each * length
            sequence += bins
        self.runs = {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(rows):
                first, each, seq, off = self.runs[int(length[rows[0]])]
                k = np.searchsorted(first, number[rows], side="right") - 1
                place = number[rows] - first[k]
                sequence[rows] = seq[k] + place // each[k]
                offset[rows] = off[k] + place % each[k] * length[rows]
        return sequence, offset


def _placed(places: Places) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.of(b.column("length").to_numpy(), b.column("number").to_numpy())
            kept = [b.column(n) for n in _PIECE_NAMES[:5]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*_PIECE_NAMES[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece as doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = scratch(pieces(docs, tokenizer, capacity, end), "pieces")
    by_block = cut.groupBy("length", "block").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = Places(pack_counts(totals, capacity))
    before = by_block.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece"))
    numbered = cut.withColumn("own", own).join(before, ["length", "block"]).withColumn("number", (F.col("before") + F.col("own") - 1).cast("long"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select(*_PIECE_NAMES[:5], "number").mapInArrow(_placed(places), schema)
