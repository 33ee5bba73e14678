"""Unigram tokenising by Viterbi over a double-array trie of pieces, and decoding.

A model file's pieces and log scores are read from its fields; nothing is trained. White space becomes
the marker, one marker is put in front of a text, and the segmentation with the largest sum of
scores is taken; of equal sums the one whose last piece starts first. A character without a
piece costs the smallest score less ten and is given as its UTF-8 bytes. No piece has
a marker after another character (a model with such a piece is refused), so texts fall apart at their markers: each task segments a
distinct chunk once, many chunks of a length at a time.

Sums are kept in double precision for each chunk. Decoding joins pieces and bytes, turns markers into
spaces and drops the first one. The text comes back as it was, but for U+2581, which is the marker
itself and comes back as a space.

Defined results: null text counts as empty; an empty text has no ids. Repeated rows are encoded alike.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

MODEL = "piece_bpe_32k.model"
MARKER = "▁".encode()
MEMO_CHUNKS, MEMO_BYTES = 300_000, 16 << 20
#: Chunks from so many bytes on are segmented one by one.
LONG = 64 << 10
UNKNOWN_COST = 10.0

#: Kinds of pieces in the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the wire format of protocol buffers."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass(frozen=True)
class Pieces:
    """Bytes, score and kind of each piece; the marker is a space byte here."""

    names: list[bytes]
    scores: list[float]
    kinds: list[int]

    @staticmethod
    def read(path: str) -> Pieces:
        names, scores, kinds = [], [], []
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                own = dict(_fields(value))
                names.append(own.get(1, b"").replace(MARKER, b" "))
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
        return Pieces(names, scores, kinds)


class DoubleArray:
    """Transitions base[state] + byte + 1, valid where check has the state; value is the piece or -1."""

    def __init__(self, keys: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in keys.items():
            node = 0
            for b in key:
                if b not in tree[node]:
                    tree[node][b] = len(tree)
                    tree.append({})
                    value.append(-1)
                node = tree[node][b]
            value[node] = v
        size = len(tree) * 2 + 1024
        base, check, self_value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        used, place, first, wide = bytearray(size + 512), [0] * len(tree), 258, 258  # from 258 on any code has a base of at least 0
        for node, children in enumerate(tree):  # parents come before their children
            if not children:
                continue
            codes = sorted(children)
            first = used.index(0, first)
            start = at = (first if len(codes) == 1 else max(first, wide)) - codes[0] - 1
            while any(used[at + c + 1] for c in codes):
                at += 1
            if len(codes) > 1 and at - start > 32:  # what lies before is dense: left to nodes with one child
                wide = at + codes[0] + 1
            if at + 512 > len(used):
                used.extend(bytes(len(used)))
            base[place[node]] = at
            if at + 257 >= len(check):
                base, check, self_value = (np.concatenate([a, np.full(len(a) + 512, f, np.int64)]) for a, f in ((base, 0), (check, -1), (self_value, -1)))
            for c in codes:
                slot = at + c + 1
                used[slot] = 1
                check[slot] = place[node]
                place[children[c]] = slot
                self_value[slot] = value[children[c]]
        last = int(np.flatnonzero(check >= 0).max(initial=0)) + 258
        fit = lambda a, f: np.concatenate([a, np.full(max(0, last - len(a)), f, np.int64)])[:last].astype(np.int32)
        self.base, self.check, self.value = fit(base, 0), fit(check, -1), fit(self_value, -1)
        self.base = np.where(self.base + 257 < last, self.base, 0).astype(np.int32)

    def prefixes(self, data: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(length, piece) of all keys that begin at ``start``."""
        state = 0
        for k in range(start, len(data)):
            to = int(self.base[state]) + data[k] + 1
            if self.check[to] != state:
                return
            state = to
            if self.value[state] >= 0:
                yield k - start + 1, int(self.value[state])


class Unigram:
    def __init__(self, pieces: Pieces):
        if any(b" " in n.lstrip(b" ") for n, k in zip(pieces.names, pieces.kinds, strict=True) if k in (NORMAL, USER_DEFINED)):
            raise ValueError("a piece has a marker after another character, so texts don't fall apart at their markers")
        normal = [s for s, k in zip(pieces.scores, pieces.kinds, strict=True) if k == NORMAL]
        low, high = min(normal, default=0.0), max(normal, default=0.0)
        self.pieces = pieces
        self.trie = DoubleArray({n: i for i, (n, k) in enumerate(zip(pieces.names, pieces.kinds, strict=True)) if k in (NORMAL, USER_DEFINED) and n})
        self.score = np.array([len(n.replace(b" ", MARKER)) * high - 0.1 if k == USER_DEFINED else s for n, s, k in zip(pieces.names, pieces.scores, pieces.kinds, strict=True)])
        self.unknown = low - UNKNOWN_COST
        bytes_ = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(pieces.names, pieces.kinds, strict=True)) if k == BYTE}
        unk = next((i for i, k in enumerate(pieces.kinds) if k == UNKNOWN), 0)
        self.byte = np.array([bytes_.get(b, unk) for b in range(256)], np.int64)
        self.text = [bytes([int(n[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else n for n, k in zip(pieces.names, pieces.kinds, strict=True)]

    def _ids(self, data: bytes, back: list[int], piece: list[int]) -> bytes:
        out, at = [], len(data)
        while at:
            start = back[at]
            out.append([piece[at]] if piece[at] >= 0 else self.byte[list(data[start:at])].tolist())
            at = start
        return np.array([i for part in reversed(out) for i in part], "<u4").tobytes()

    def segment(self, data: bytes) -> bytes:
        """Ids of one chunk."""
        best, back, piece = array("d", [-np.inf]) * (len(data) + 1), array("i", [0]) * (len(data) + 1), array("i", [-1]) * (len(data) + 1)
        best[0], at = 0.0, 0
        while at < len(data):
            b = data[at]
            width = 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            single = False
            for n, i in self.trie.prefixes(data, at):
                single |= n == width
                if best[at] + self.score[i] > best[at + n]:
                    best[at + n], back[at + n], piece[at + n] = best[at] + self.score[i], at, i
            if not single and best[at] + self.unknown > best[at + width]:
                best[at + width], back[at + width], piece[at + width] = best[at] + self.unknown, at, -1
            at += width
        return self._ids(data, back, piece)

    def segment_many(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks of one length, all advanced together."""
        length, n = len(chunks[0]), len(chunks)
        data = np.frombuffer(b"".join(chunks), np.uint8).reshape(n, length).astype(np.int32)
        best, back, piece = np.full((length + 1, n), -np.inf), np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int32)
        best[0] = 0.0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for at in range(length):
            first = data[:, at]
            rows = np.flatnonzero((first < 0x80) | (first >= 0xC0))
            width = np.ones(n, np.int32)
            width[first >= 0xC0], width[first >= 0xE0], width[first >= 0xF0] = 2, 3, 4
            single = np.zeros(n, bool)
            state, live = np.zeros(len(rows), np.int32), rows
            for k in range(at, length):
                to = base[state] + data[live, k] + 1
                ok = check[to] == state
                live, state = live[ok], to[ok]
                if not len(live):
                    break
                hit = value[state] >= 0
                if hit.any():
                    who, what = live[hit], value[state[hit]]
                    single[who] |= width[who] == k - at + 1
                    gain = best[at, who] + self.score[what]
                    better = gain > best[k + 1, who]
                    who = who[better]
                    best[k + 1, who], back[k + 1, who], piece[k + 1, who] = gain[better], at, what[better]
            lone = rows[~single[rows]]
            for w in np.unique(width[lone]).tolist():
                who = lone[width[lone] == w]
                gain = best[at, who] + self.unknown
                better = gain > best[at + w, who]
                who = who[better]
                best[at + w, who], back[at + w, who], piece[at + w, who] = gain[better], at, -1
        return self._traced(data, back, piece, n, length)

    def _traced(self, data: np.ndarray, back: np.ndarray, piece: np.ndarray, n: int, length: int) -> list[bytes]:
        """Follow all chunks from their ends; ids are written from the right."""
        ids, fill = np.zeros((n, length), "<u4"), np.full(n, length, np.int64)
        at, rows = np.full(n, length, np.int64), np.arange(n)
        while len(rows):
            end = at[rows]
            start, what = back[end, rows], piece[end, rows]
            known = what >= 0
            r = rows[known]
            fill[r] -= 1
            ids[r, fill[r]] = what[known]
            for row, a, b in zip(rows[~known].tolist(), start[~known].tolist(), end[~known].tolist(), strict=True):
                fill[row] -= b - a
                ids[row, fill[row] : fill[row] + b - a] = self.byte[data[row, a:b]]
            at[rows] = start
            rows = rows[start > 0]
        flat, row_bytes = ids.tobytes(), 4 * length
        return [flat[row_bytes * r + 4 * f : row_bytes * (r + 1)] for r, f in enumerate(fill.tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        out = b"".join(map(self.text.__getitem__, ids.tolist()))
        return out[1:] if out[:1] == b" " else out


_CHUNK = re.compile(rb" +[^ ]*")


class Encoder(dict):
    """Ids of the chunks met so far, as little-endian unsigned 32-bit numbers."""

    def __init__(self, model: Unigram):
        self.model = model
        self.bytes = 0

    def learn(self, chunks: set[bytes]) -> None:
        by_length: dict[int, list[bytes]] = {}
        for c in chunks:
            if c not in self:
                self.bytes += len(c)
                by_length.setdefault(len(c), []).append(c)
        for same in by_length.values():
            if len(same) < 6 or len(same[0]) >= LONG:
                for c in same:
                    self[c] = self.model.segment(c)
            else:
                for k in range(0, len(same), step := max(6, 400_000 // len(same[0]))):
                    part = same[k : k + step]
                    self.update(zip(part, self.model.segment_many(part), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [_CHUNK.findall(b" " + t.replace(MARKER, b" ")) if t else [] for t in texts]
        if len(self) > MEMO_CHUNKS or self.bytes > MEMO_BYTES:
            self.clear()
            self.bytes = 0
        self.learn(set().union(*split) if split else set())
        return [b"".join(map(self.__getitem__, chunks)) for chunks in split]


def _round_trip(pieces: Pieces) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches, 128):
            encoder = encoder or Encoder(Unigram(pieces))
            texts = text_bytes(batch.column(1))
            rows = []
            for text, ids in zip(texts, encoder.encode(texts), strict=True):
                back = encoder.model.decode(np.frombuffer(ids, "<u4"))
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back).hexdigest(), back == text))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return run


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 and round_trip of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_round_trip(Pieces.read(model)), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def _ids(pieces: Pieces) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches, 128):
            encoder = encoder or Encoder(Unigram(pieces))
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in encoder.encode(text_bytes(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and the array of ids of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_ids(Pieces.read(model)), "doc_id long, ids array<int>")


def _texts(pieces: Pieces) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(pieces)
        for batch in slices(batches, 128):
            texts = [model.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(ids: DataFrame, model: str) -> DataFrame:
    """doc_id and the text of every row of :func:`encode`."""
    return ids.select("doc_id", "ids").mapInArrow(_texts(Pieces.read(model)), "doc_id long, text string")
