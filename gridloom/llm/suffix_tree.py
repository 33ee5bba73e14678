"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are words, A-Z lower-cased, and one end for each text; a text starts in the context ``end``.

The tree. Without context a known word has the share (c - d) / N of its count; the mass d V / N of the V known
words goes to spelled words: any word's probability under a chain of bytes learned from the known words.
So unseen words have a proper probability too, and all words' probabilities sum to at most one. A
context is the last one, two, three or more tokens. Its next-token counts n(c, w) of ``least`` or more are stored;
what they leave over goes to the suffix: p(w | c) = max(n(c, w) - d, 0) / n(c) + back(c) p(w | suffix).
A context is tried if its suffix is retained and it occurs ``least`` times, and retained if its stored distribution
diverges from its suffix's by more than it costs to describe:
sum over stored w of n log(share / p(w | suffix)) + (n(c) - stored) log back >= K / 2 log n(c), K stored words.
The depth has no bound: levels are added until no context of any text is left to try. A token is
scored in the longest retained suffix of what precedes it.

The model lies in tables that grow with the corpus; nobody holds it whole. Texts are cut into blocks of token
numbers, written once. For each level a block sends its distinct contexts and next words, packed by the
hash of the context, and is sent back their totals and each context's verdict; from those it makes the
probabilities of its own tokens and the next level's contexts. What a block holds of the tokens still in play is
kept from level to level once it is small (probabilities in single precision). A context that makes up more than a part's
share of the tokens is dealt to several parts by its next words, its sums are added up on the driver: at most
two a part. A part too large for memory is worked off by ranges of hashes from a file of its task.

Contexts are told apart by 64-bit hashes and next words of one context by 24 to 40 bits, the more the more frequent it is; counts of words are exact.
The suffix's probability in the divergence test is rounded to an eighth of an octave, below 2^-16 to a step that grows with its depth, up to an octave at 2^-80 (``OCTAVES``).

Defined results: a null text is empty and has the end alone. A null doc_id belongs to the training rows.
Without training rows the end has one half, and spelled words the other. Repeated rows count and
are returned as often as given. No rows: no rows. Extra columns are not read.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, crc_remainder, content_bytes, recorded, release, scratch, tokenised

END_WORD = b"\n"  # no word holds white space
LETTERS = 257  # bytes, and 256 for the start as what precedes and the end as what follows
WORD_BITS = 40


@dataclass(frozen=True)
class Settings:
    discount: float = 0.5
    least: int = 2
    block_bytes: int = 5 << 20
    part_tokens: int = 1 << 20
    most_parts: int = 4096
    part_bytes: int = 96 << 20


# Packed arrays and hashes


def _packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpacked(raw: bytes, *types: str) -> list[np.ndarray]:
    buffer = zstandard.ZstdDecompressor().decompress(raw)
    at, out = 8 * len(types), []
    for n, t in zip(np.frombuffer(buffer, np.int64, len(types)).tolist(), types, strict=True):
        out.append(np.frombuffer(buffer, t, n, at))
        at += out[-1].nbytes
    return out


def _planes(x: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bytes of each number, all lowest ones first; small numbers then compress to little."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).ravel()


def _from_planes(planes: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = planes.reshape(width, -1).T
    return out.view("<i8").ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary ``words`` in one row, and where each ends, from 0."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def _words_of(lengths: np.ndarray, raw: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def word_hashes(words: pa.Array) -> np.ndarray:
    raw, ends = _flat(words)
    size = np.diff(ends)
    place = np.arange(len(raw)) - np.repeat(ends[:-1], size)
    drawn = _mix(np.arange(1, int(size.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * drawn[place], dtype=np.uint64)])
    return _mix(sums[ends[1:]] - sums[ends[:-1]] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _letter_pairs(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(before * LETTERS + next) along all words, each with its start and end, and where each word begins."""
    raw, ends = _flat(words)
    number = np.arange(len(words))
    at = np.arange(len(raw)) + np.repeat(number, np.diff(ends))
    before, after = np.full(len(raw) + len(words), 256), np.full(len(raw) + len(words), 256)
    after[at] = raw
    before[at + 1] = raw
    return before * LETTERS + after, ends[:-1] + number


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending; the place of each row's key among them; a row of each."""
    order = np.argsort(key)
    own = key[order]
    new = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return own[new], place, order[new]


# The model


@dataclass(frozen=True)
class Model:
    """What all tasks share; of bounded size. ``hot``: for each level the hashes, sums and numbers of stored words of split contexts."""

    settings: Settings
    word_parts: int
    parts: int = 1
    tokens: int = 0
    distinct: int = 0
    letters: np.ndarray = field(default_factory=lambda: np.full(LETTERS**2, -np.log(LETTERS)), repr=False)
    hot: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...] = ()

    def spelled(self, words: pa.Array) -> np.ndarray:
        """Natural log of each word's probability under the chain of bytes."""
        pairs, begins = _letter_pairs(words)
        return np.add.reduceat(self.letters[pairs], begins) if len(words) else np.zeros(0)

    def splits(self, total: np.ndarray) -> np.ndarray:
        """Over how many parts a context of so many occurrences is dealt."""
        return np.clip(-(-total * self.parts // max(self.tokens, 1)), 1, self.parts)

    def retained(self, total: np.ndarray, stored: np.ndarray, kinds: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """``gain``: sum of n (log(n - d) - log p(w | suffix)) over stored next words."""
        total = np.maximum(total, 1).astype(float)
        back = 1 - (stored - self.settings.discount * kinds) / total
        whole = gain - stored * np.log(total) + (total - stored) * np.log(np.maximum(back, 1e-300))
        return (kinds > 0) & (whole >= 0.5 * kinds * np.log(total))


def letter_model(counts: dict[int, int]) -> np.ndarray:
    n = np.full(LETTERS**2, 0.1)
    for pair, k in counts.items():
        n[pair] += k
    n = n.reshape(LETTERS, LETTERS)
    return np.log(n / n.sum(axis=1, keepdims=True)).ravel()


# Blocks of texts

_BLOCK = "block long, docs binary, ids binary, words binary"


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _blocks(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, held_out, text -> blocks of about ``block_bytes`` of text: rows, numbers of all tokens, distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 24, [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            words, at, n = tokenised(t.column("text").combine_chunks())
            often = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(words), np.int64)
            rank[often] = np.arange(len(words))
            words, at = words.take(pa.array(often)), rank[at]
            stops = np.cumsum(n + 1)
            ids = np.zeros(int(stops[-1]), np.int32)
            ids[np.arange(len(at)) + np.repeat(np.arange(len(n)), n)] = at + 1
            raw, ends = _flat(pa.concat_arrays([pa.array([END_WORD], pa.binary()), words]))
            docs = t.drop_columns("text").append_column("n", pa.array(n + 1))
            row = [block, _ipc(docs), _packed(_planes(ids, 4)), _packed(np.diff(ends).astype(np.int32), raw)]
            return pa.RecordBatch.from_arrays([pa.array([row[0]]), *(pa.array([x], pa.binary()) for x in row[1:])], names=["block", "docs", "ids", "words"])

        for batch in by_bytes(batches, 2, block_bytes):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(2))).as_py() or 0
            if size >= block_bytes or sum(b.num_rows for b in held) >= block_bytes // 16:
                yield flush()
                block, held, size = block + 1, [], 0
        if any(b.num_rows for b in held):
            yield flush()

    return run


@dataclass
class Block:
    docs: pa.Table
    ids: np.ndarray
    words: pa.Array
    hashes: np.ndarray
    starts: np.ndarray
    train: np.ndarray  # by token

    @classmethod
    def of(cls, docs: bytes, ids: bytes, words: bytes) -> Block:
        table = pa.ipc.open_stream(docs).read_all()
        n = table["n"].to_numpy()
        own = _words_of(*_unpacked(words, "i4", "u1"))
        return cls(table, _from_planes(_unpacked(ids, "u1")[0], 4), own, word_hashes(own), np.cumsum(n) - n, np.repeat(~np.asarray(table["held_out"]), n))

    def word_order(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        part = (self.hashes % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((self.hashes, part))
        return order, part[order]


def _runs(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, start, stop) of ascending ``part``."""
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    yield from zip(part[edges].tolist(), edges.tolist(), np.append(edges[1:], len(part)).tolist(), strict=True)


_PACKET = "part int, block long, payload binary"


def _packets(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, block, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(payload, pa.binary())], names=["part", "block", "payload"])


def _send_words(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = Block.of(*row)
                n = np.bincount(own.ids, weights=own.train, minlength=len(own.words)).astype(np.int64)
                order, part = own.word_order(parts)
                raw, ends = _flat(own.words.take(pa.array(order)))
                yield _packets([(p, block, _packed(np.diff(ends[i : j + 1]).astype(np.int32), n[order[i:j]], raw[ends[i] : ends[j]])) for p, i, j in _runs(part)])

    return run


# Parts

_RETURN = "level int, block long, part int, seq int, payload binary"
#: What else than a block's returns stands in ``block``: sums of the corpus, of split contexts, scores, and from STATE downwards a block's kept state.
SUMS, HOT, SCORES, STATE = -1, -2, -3, -4


class _Spool:
    """The packets of a part, in memory up to ``most`` bytes unpacked, beyond that in a file of the task."""

    def __init__(self, most: int):
        self.most, self.held, self.bytes, self.file, self.sizes = most, [], 0, None, []

    def add(self, block: int, payload: bytes, size: int) -> None:
        self.bytes += size
        if self.file is None and self.bytes > self.most:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115
            for x in self.held:
                self._write(*x)
            self.held.clear()
        if self.file is None:
            self.held.append((block, payload))
        else:
            self._write(block, payload)

    def _write(self, block: int, payload: bytes) -> None:
        self.file.write(payload)
        self.sizes.append((block, len(payload)))

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        if self.file is None:
            yield from self.held
            return
        self.file.seek(0)
        for block, n in self.sizes:
            yield block, self.file.read(n)

    def ranges(self) -> list[tuple[int, int]]:
        """Ranges of hashes that split the packets to pieces of about ``most`` bytes."""
        k = max(1, -(-self.bytes // self.most))
        edges = [(r << 64) // k for r in range(k)] + [1 << 64]
        return list(zip(edges[:-1], edges[1:], strict=True))


def _by_part(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, _Spool]]:
    """Rows sorted by part -> the packets of each part."""
    part, spool = None, None
    for b in batches:
        for p, block, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != part:
                if spool is not None:
                    yield part, spool
                part, spool = p, _Spool(most)
            spool.add(block, payload, zstandard.frame_content_size(payload) if p >= 0 else len(payload))
    if spool is not None:
        yield part, spool


def _within(hashes: np.ndarray, low: int, high: int) -> tuple[int, int]:
    return int(np.searchsorted(hashes, np.uint64(low))), len(hashes) if high >= 1 << 64 else int(np.searchsorted(hashes, np.uint64(high)))


def _returned(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["level", "block", "part", "seq", "payload"])


def _total_words(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Totals of all words for the blocks that sent them; tokens, distinct words and pairs of letters of the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, spool in _by_part(batches, most):
            for seq, (low, high) in enumerate(spool.ranges()):
                blocks, words, counts = [], [], []
                for block, payload in spool:
                    lengths, n, raw = _unpacked(payload, "i4", "i8", "u1")
                    own = _words_of(lengths, raw)
                    i, j = _within(word_hashes(own), low, high)
                    blocks.append(block)
                    words.append(own.slice(i, j - i))
                    counts.append(n[i:j])
                met = pa.concat_arrays(words).dictionary_encode()
                at, n = met.indices.to_numpy(), np.concatenate(counts)
                total = np.bincount(at, weights=n, minlength=len(met.dictionary)).astype(np.int64)
                stops = np.cumsum([len(c) for c in counts]).tolist()
                rows = [(0, block, part, seq, _packed(total[at[i:j]])) for block, i, j in zip(blocks, [0, *stops[:-1]], stops, strict=True)]
                known = total > 0
                ends = int(total[pc.index(met.dictionary, pa.scalar(END_WORD, pa.binary())).as_py()]) if pc.index(met.dictionary, pa.scalar(END_WORD, pa.binary())).as_py() >= 0 else 0
                spelled = met.dictionary.filter(pa.array(known & ~np.asarray(pc.equal(met.dictionary, pa.scalar(END_WORD, pa.binary())))))
                pairs = np.bincount(_letter_pairs(spelled)[0], minlength=LETTERS**2) if len(spelled) else np.zeros(LETTERS**2, np.int64)
                pairs = np.append(pairs, [total.sum(), known.sum(), ends])
                kinds = np.flatnonzero(pairs)
                yield _returned([*rows, (0, SUMS, part, seq, _packed(kinds, pairs[kinds].astype(np.int64)))])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for payload in b.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _unpacked(payload, "i8", "i8")], names=["pair", "n"])


_CONTEXTS = ("u1", "i8", "i4", "u1", "i4", "u1")  # of a packet: context (planes of steps), its occurrences, its entries; an entry's word (planes), count, rounded probability
#: Bytes of the planes of an entry's word.
WORD_WIDTH = 5


#: What a byte says of a probability: minus its binary logarithm.
OCTAVES = np.append(np.arange(128) / 8, 16 + np.arange(128) ** 2 / 252)
_BETWEEN = (OCTAVES[1:] + OCTAVES[:-1]) / 2


def rounded_octaves(probability: np.ndarray) -> np.ndarray:
    """The byte whose ``OCTAVES`` are nearest."""
    return np.searchsorted(_BETWEEN, -np.log2(probability)).astype(np.uint8)


def _word_bits(occur: np.ndarray) -> np.ndarray:
    """A mask of the bits of a next word's hash that tell the few words of a context of so many occurrences apart as well as 40 bits do those of a frequent one."""
    return np.where(occur <= 16, (1 << 24) - 1, np.where(occur <= 256, (1 << 32) - 1, (1 << WORD_BITS) - 1))


def _judge(m: Model, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Totals of all (context, next word), and which contexts are retained, for the blocks that asked."""
    d, least = m.settings.discount, m.settings.least

    def judged(part: int, seq: int, blocks: list[int], packets: list[list[np.ndarray]]) -> list[tuple]:
        context, total, entries, word, n, rounded = (np.concatenate(x) for x in zip(*packets, strict=True))
        kinds, at, sample = _groups(context)
        occur = total[sample]
        key = (np.repeat(at, entries) << WORD_BITS) | word
        own, place, one = _groups(key)
        sums = np.bincount(place, weights=n, minlength=len(own)).astype(np.int64)
        kept = np.flatnonzero(sums >= least)
        of = own[kept] >> WORD_BITS
        stored = np.bincount(of, weights=sums[kept], minlength=len(kinds)).astype(np.int64)
        words = np.bincount(of, minlength=len(kinds))
        gain = np.bincount(of, weights=sums[kept] * (np.log(sums[kept] - d) + OCTAVES[rounded[one[kept]]] * np.log(2)), minlength=len(kinds))
        split = m.splits(occur) > 1
        fine = m.retained(occur, stored, words, gain) & ~split
        sums[sums < least] = 0
        back, stored_out, words_out = sums[place], np.where(fine, stored, 0)[at], np.where(fine, words, 0)[at]
        rows, i, j = [], 0, 0
        for block, p in zip(blocks, packets, strict=True):
            rows.append((level, block, part, seq, _packed(stored_out[i : i + len(p[0])], words_out[i : i + len(p[0])], back[j : j + len(p[3])])))
            i, j = i + len(p[0]), j + len(p[3])
        if split.any():
            rows.append((level, HOT, part, seq, _packed(kinds[split], occur[split], stored[split], words[split], gain[split])))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, spool in _by_part(batches, m.settings.part_bytes):
            if part < 0:  # scores and states pass through
                for block, payload in spool:
                    yield _returned([(level, block, part, 0, payload)])
                continue
            for seq, (low, high) in enumerate(spool.ranges()):
                blocks, packets = [], []
                for block, payload in spool:
                    p = _unpacked(payload, *_CONTEXTS)
                    p[0], p[3] = np.cumsum(_from_planes(p[0], 8).view("<u8"), dtype=np.uint64), _from_planes(p[3], WORD_WIDTH)
                    i, j = _within(p[0], low, high)
                    ends = np.concatenate([[0], np.cumsum(p[2])])
                    blocks.append(block)
                    packets.append([*(x[i:j] for x in p[:3]), *(x[ends[i] : ends[j]] for x in p[3:])])
                yield _returned(judged(part, seq, blocks, packets))

    return run


# Levels

STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class State:
    """The tokens of a block that have a context of the next level to try; all others are added up in ``done``."""

    docs: pa.Table  # doc_id, held_out, n_tokens, n_known, base_score
    done: np.ndarray  # natural log of the probability of finished tokens, by document
    at: np.ndarray  # place of a token in the block
    doc: np.ndarray
    word: np.ndarray  # number among ``words``
    context: np.ndarray  # number among ``contexts``
    has: np.ndarray  # whether its entry may be stored
    prob: np.ndarray  # probability so far; for unseen words without their spelling, which is in ``done``
    words: np.ndarray  # hashes
    contexts: np.ndarray  # hashes
    occur: np.ndarray  # of each context

    def packed(self) -> bytes:
        used = np.zeros(len(self.words), bool)
        used[self.word] = True
        word = (np.cumsum(used) - 1)[self.word].astype(np.int32)
        raw = np.frombuffer(_ipc(self.docs), np.uint8)
        return _packed(raw, self.done, self.at.astype(np.int32), self.doc.astype(np.int32), word, self.context.astype(np.int32), self.has.astype(np.uint8), self.prob.astype(np.float32), self.words[used], self.contexts, self.occur)

    @classmethod
    def unpacked(cls, payload: bytes) -> State:
        raw, done, at, doc, word, context, has, prob, words, contexts, occur = _unpacked(payload, "u1", "f8", "i4", "i4", "i4", "i4", "u1", "f4", "u8", "u8", "i8")
        return cls(pa.ipc.open_stream(raw.tobytes()).read_all(), done, at, doc, word, context, has.astype(bool), prob.astype(float), words, contexts, occur)

    def carried(self, rows: np.ndarray, context: np.ndarray, has: np.ndarray, prob: np.ndarray, contexts: np.ndarray, occur: np.ndarray, least: int) -> State:
        """The state of the ``rows`` that stay, with their contexts' numbers among the given ones; the rest is done.

        A context of which all but less than ``least`` occurrences are followed, here, by words that can't be stored has none stored and is done as well."""
        lost = np.bincount(context, weights=~has[rows] & ~np.asarray(self.docs["held_out"])[self.doc[rows]], minlength=len(contexts))
        fine = (occur - lost >= least)[context]
        rows, context = rows[fine], context[fine]
        rest = np.ones(len(self.at), bool)
        rest[rows] = False
        done = self.done + np.bincount(self.doc[rest], weights=np.log(prob[rest]), minlength=len(self.done))
        used = np.zeros(len(contexts), bool)
        used[context] = True
        return State(self.docs, done, self.at[rows], self.doc[rows], self.word[rows], (np.cumsum(used) - 1)[context], has[rows], prob[rows], self.words, contexts[used], occur[used])


def _first_state(own: Block, count: np.ndarray, m: Model) -> State:
    """All tokens without context; ``count``: of each word."""
    d, n = m.settings.discount, own.docs["n"].to_numpy()
    spelled = m.spelled(own.words)
    spelled[0] = -np.inf  # the end is not spelled
    if m.tokens:
        mass = d * m.distinct / m.tokens
        known = (count - d) / m.tokens + mass * np.exp(spelled)
    else:
        mass, known, spelled[0] = 0.5, np.ones(len(count)), 0.0
    known[count == 0] = 1.0
    unseen = np.where(count > 0, 0.0, np.log(mass) + np.where(count > 0, 0.0, spelled))
    base = np.log10((count + 1) / (m.tokens + m.distinct + 1))
    sums = lambda of_word: np.add.reduceat(of_word[own.ids], own.starts)
    docs = pa.table({"doc_id": own.docs["doc_id"], "held_out": own.docs["held_out"], "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(sums((count > 0).astype(np.int64))), "base_score": pa.array(sums(base))})
    before = np.roll(own.ids, 1)
    before[own.starts] = 0
    everything = np.arange(len(own.ids))
    state = State(docs, sums(unseen), everything, np.repeat(np.arange(len(n)), n), own.ids, before, count[own.ids] >= m.settings.least, known[own.ids], own.hashes, own.hashes, count)
    rows = np.flatnonzero(count[before] >= m.settings.least)
    return state.carried(rows, before[rows], state.has, state.prob, own.hashes, count, m.settings.least)


@dataclass
class Plan:
    """A state's contexts and entries, in the order in which they are sent and come back."""

    slots: np.ndarray  # context of each slot, in order of part and hash
    parts: np.ndarray  # part of each slot
    rows: np.ndarray  # tokens with an entry
    place: np.ndarray  # each such token's entry
    slot: np.ndarray  # of each entry
    word: np.ndarray  # of each entry
    sample: np.ndarray  # a token of each entry


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


def _plan(state: State, m: Model) -> Plan:
    n = m.splits(state.occur)
    first = np.cumsum(n) - n
    slots = np.repeat(np.arange(len(n)), n)
    part = ((state.contexts[slots] + (np.arange(len(slots)) - first[slots]).astype(np.uint64)) % np.uint64(m.parts)).astype(np.int64)
    order = np.lexsort((state.contexts[slots], part))
    rank = np.empty(len(slots), np.int64)
    rank[order] = np.arange(len(slots))
    rows = np.flatnonzero(state.has)
    context, word = state.context[rows], state.word[rows].astype(np.int64)
    slot = first[context]
    if (n > 1).any():
        slot = slot + (state.words[word] >> np.uint64(64 - WORD_BITS)).astype(np.int64) % n[context]
    low, index = _bits(len(state.words)), _bits(len(rows))
    key = (rank[slot] << low) | word
    if _bits(len(slots)) + low + index < 64:  # sorted together with the rows' numbers
        both = np.sort((key << index) | np.arange(len(rows)))
        by, key = both & ((1 << index) - 1), both >> index
    else:
        by = np.argsort(key, kind="stable")
        key = key[by]
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    place = np.empty(len(rows), np.int64)
    place[by] = np.cumsum(new) - 1
    key = key[new]
    return Plan(slots[order], part[order], rows, place, key >> low, key & ((1 << low) - 1), rows[by[new]])


def _sent(state: State, p: Plan, block: int) -> list[tuple[int, int, bytes]]:
    train = ~np.asarray(state.docs["held_out"])
    n = np.bincount(p.place, weights=train[state.doc[p.rows]], minlength=len(p.word)).astype(np.int32)
    rounded = rounded_octaves(state.prob[p.sample])
    word = (state.words[p.word] >> np.uint64(64 - WORD_BITS)).astype(np.int64) & _word_bits(state.occur[p.slots[p.slot]])
    entries = np.bincount(p.slot, minlength=len(p.slots)).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(entries)])
    out = []
    for part, i, j in _runs(p.parts):
        a, b = ends[i], ends[j]
        out.append((part, block, _packed(_planes(np.diff(state.contexts[p.slots[i:j]], prepend=np.uint64(0)), 8), state.occur[p.slots[i:j]], entries[i:j], _planes(word[a:b], WORD_WIDTH), n[a:b], rounded[a:b])))
    return out


def _next_state(state: State, p: Plan, payloads: list[bytes], hot: tuple[np.ndarray, np.ndarray, np.ndarray], m: Model) -> State:
    """The state of the next level, from the totals and verdicts that came back."""
    d, least = m.settings.discount, m.settings.least
    stored, words, total = (np.concatenate(x) for x in zip(*(_unpacked(x, "i8", "i8", "i8") for x in payloads), strict=True))
    s, k = np.zeros(len(state.contexts), np.int64), np.zeros(len(state.contexts), np.int64)
    s[p.slots], k[p.slots] = stored, words
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], state.contexts), len(hot[0]) - 1)
        met = hot[0][at] == state.contexts
        s[met], k[met] = hot[1][at[met]], hot[2][at[met]]
    n = np.zeros(len(state.at), np.int64)
    n[p.rows] = total[p.place]
    entry = np.full(len(state.at), -1, np.int64)
    entry[p.rows] = p.place
    back = np.where(k > 0, 1 - (s - d * k) / np.maximum(state.occur, 1), 1.0)
    kept = (k > 0)[state.context]
    prob = back[state.context] * state.prob
    own = np.flatnonzero(kept & (n > 0))
    prob[own] += (n[own] - d) / state.occur[state.context[own]]
    follows = np.zeros(len(state.at), bool)  # the token before has a context as well
    follows[1:] = (state.at[1:] == state.at[:-1] + 1) & (state.doc[1:] == state.doc[:-1])
    rows = np.flatnonzero(kept & follows)
    # a context as frequent as its suffix has its suffix's distribution: it diverges by nothing, nor does a longer one by more than its own suffix
    rows = rows[(n[rows - 1] >= least) & (n[rows - 1] < state.occur[state.context[rows]])]
    longer = _mix(state.contexts[p.slots[p.slot]] * STEP + state.words[p.word])
    return state.carried(rows, entry[rows - 1], n >= least, prob, longer, total, least)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(state: State, m: Model) -> bytes:
    out = state.docs.drop_columns("base_score").append_column("train_tokens", pa.array(np.full(len(state.done), m.tokens, np.int64)))
    return _ipc(out.append_column("base_score", state.docs["base_score"]).append_column("score", pa.array(state.done / np.log(10))))


#: From this level on a block's state, small by then, is kept from level to level; before, it is made anew from the block.
KEPT_FROM = 4


def _advance(m: Model, level: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block or its kept state, with what came back for the levels before -> its packets of this level, or its scores if no context is left to try."""

    def advanced(left: pa.Table, right: pa.Table) -> list[tuple[int, int, bytes]]:
        back: dict[int, list[tuple[int, int, bytes]]] = {}
        for lev, part, seq, payload in zip(*(right[c].to_pylist() for c in ("level", "part", "seq", "payload")), strict=True):
            back.setdefault(lev, []).append((part, seq, payload))
        if not left.num_rows or level - 1 not in back:  # its scores are there already
            return []
        block = left["block"][0].as_py()
        of = lambda lev: [x[2] for x in sorted(back[lev])]
        if "state" in left.column_names:
            state, done = State.unpacked(left["state"][0].as_py()), level - 1
        else:
            own = Block.of(*(left[c][0].as_py() for c in ("docs", "ids", "words")))
            count = np.zeros(len(own.words), np.int64)
            count[own.word_order(m.word_parts)[0]] = np.concatenate([_unpacked(x, "i8")[0] for x in of(0)])
            state, done = _first_state(own, count, m), 1
        for lev in range(done, level):
            if len(state.at):
                state = _next_state(state, _plan(state, m), of(lev), m.hot[lev], m)
        passed_on = -1 - block % m.parts
        if not len(state.at):
            return [(passed_on, SCORES, _scored(state, m))]
        kept = [(passed_on, STATE - block, state.packed())] if level >= KEPT_FROM else []
        return kept + _sent(state, _plan(state, m), block)

    return lambda left, right: pa.Table.from_batches([_packets(advanced(left, right))])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for payload in b.column(0).to_pylist():
            yield from pa.ipc.open_stream(payload).read_all().to_batches()


def _hot(rows: list, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds up the sums of split contexts, at most two a part, and keeps those that pass."""
    parts = [_unpacked(r["payload"], "u8", "i8", "i8", "i8", "f8") for r in rows]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    context, occur, stored, words, gain = (np.concatenate(x) for x in zip(*parts, strict=True))
    kinds, at, sample = _groups(context)
    s, k, g = (np.bincount(at, weights=x, minlength=len(kinds)) for x in (stored, words, gain))
    fine = m.retained(occur[sample], s, k, g)
    return kinds, np.where(fine, s, 0).astype(np.int64), np.where(fine, k, 0).astype(np.int64)


def _forget_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished levels go when the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score_documents(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 7 is not 2 and score all rows."""
    spark = docs.sparkSession
    held_out = F.coalesce(crc_remainder("doc_id", 7) == 2, F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    used: list[str] = []
    size = min(s.block_bytes, max(1 << 19, content_bytes(slim) // (2 * spark.sparkContext.defaultParallelism)))  # a small table still makes work for all tasks
    with recorded(used):
        blocks = scratch(slim.mapInArrow(_blocks(size), _BLOCK), "blocks")
        m = Model(s, min(s.most_parts, max(1, blocks.count())))

        def totals(packets: DataFrame, parts: int, reduce: Callable, name: str) -> DataFrame:
            return scratch(packets.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(reduce, _RETURN), name)

        back = [totals(blocks.mapInArrow(_send_words(m.word_parts), _PACKET), m.word_parts, _total_words(s.part_bytes), "word-totals")]
        sums = back[0].filter(F.col("block") == SUMS).select("payload").mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        found = {r["pair"]: r["n"] for r in sums.collect()}  # at most LETTERS ** 2 + 3 rows
        tokens, distinct, _ = (found.pop(LETTERS**2 + k, 0) for k in range(3))
        m = replace(m, parts=min(s.most_parts, max(1, -(-tokens // s.part_tokens))), tokens=tokens, distinct=distinct, letters=letter_model(found), hot=((np.zeros(0, np.uint64),) * 3,))
        level, left = 0, blocks
        while not back[-1].filter("block >= 0").isEmpty():
            level += 1
            known = back[-1] if level > KEPT_FROM else back[0]
            for b in back[1:] if level <= KEPT_FROM else []:
                known = known.unionByName(b)
            if level > KEPT_FROM:
                left = back[-1].filter(F.col("block") <= STATE).select((F.lit(STATE) - F.col("block")).alias("block"), F.col("payload").alias("state"))
            sent = left.groupBy("block").cogroup(known.filter("block >= 0").groupBy("block")).applyInArrow(_advance(m, level), _PACKET)
            back.append(totals(sent, m.parts, _judge(m, level), "suffix-level"))
            m = replace(m, hot=(*m.hot, _hot(back[-1].filter(F.col("block") == HOT).select("payload").collect(), m)))
            _forget_shuffles(spark)
        scores = back[0].limit(0)
        for b in back[1:]:
            scores = scores.unionByName(b.filter(F.col("block") == SCORES))
        last: list[str] = []
        with recorded(last):
            out = scratch(scores.select("payload").mapInArrow(_rows_of, _SCORES), "suffix-scores")
    release(spark, [x for x in used if x not in last])
    return out
