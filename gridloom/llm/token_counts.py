"""Token counts of every prefix of a text, by dynamic programming over prefixes.

A byte-pair encoder joins pairs of neighbours in the order of its merges, within the words that its pattern cuts.
Two neighbouring tokens of a result never join any more; whether two tokens can stand beside each other is
told by the merges that made them alone (``Vocabulary.apart``). So of all tokens that a prefix of a word may end with just one can stand
behind the last token of the rest, and

    count[end] = count[end - length of that token] + 1,

one pass over the word, that stores the exact count at every prefix: ``Vocabulary.prefixes`` of a word, and
``Vocabulary.text_prefixes`` of a text, also where a cut would part a run of white space, a contraction or an added token and so
change how the pattern cuts. From the stored counts follow the count of the whole text, the longest
prefix within a budget and all sums of budgets, without encoding anything again (``stored``, ``longest_within``).

``counted`` gives the counts of whole texts only. A batch's distinct words are counted once.

Defined results: null text counts as empty: no bytes, no tokens. Null ids and repeated rows are counted like others. No rows: no rows.
Extra columns are not read. Text of an added token inside a text is that token, as the library has it by default.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

MODEL = "byte_bpe_50k.json"
LIMIT = 512
BATCH_BYTES = 16 << 20
#: Counts and pairs a worker remembers at most.
MEMO = 1 << 19

#: Fixed: the pattern of byte-level encoders, and the contractions of it that a cut after two characters parts.
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PARTED = ("'re", "'ve", "'ll")
#: The same cut in the classes of ``re``, which is faster, and the characters up to U+052F whose class it takes for another one.
_QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_NOT_QUICK = r"\x00\x1c-\x1f\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}"
#: Below this character the pattern's classes are those of the library whatever its Unicode version.
_SETTLED = "԰"
_WHITE = regex.compile(r"\s")
#: The pattern's white space, and words that are empty or have it at an edge.
_SPACES = r"\t-\r\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_EDGES = (rf"^([{_SPACES}]|$)", rf"(^|[{_SPACES}])$")
_WHITE_RUN = regex.compile(r"\s\s")


def _byte_names() -> dict[str, int]:
    """The characters by which byte-level vocabularies name bytes: printable ones name themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabulary:
    """Tokens as numbers: a byte is itself, what merge k makes is 256 + k."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parsed = json.loads(definition)
        model, added, cut = parsed["model"], parsed.get("added_tokens") or [], parsed["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not parsed["normalizer"]
        if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("not a plain byte-level encoder")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or regex.search(r"\s", t["content"]) for t in added):
            raise ValueError("an added token reaches over white space")
        self.library = Tokenizer.from_str(definition).pre_tokenizer
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) or "(?!)")
        names = _byte_names()
        self.left, self.right = [0] * 256, [0] * 256
        self.rank: dict[tuple[int, int], int] = {}
        made = {bytes([b]): b for b in range(256)}
        for k, pair in enumerate(model["merges"]):
            a, b = (bytes(names[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            if a + b in made:
                raise ValueError("two merges make one token")
            made[a + b] = 256 + k
            self.left.append(made[a])
            self.right.append(made[b])
            self.rank[made[a], made[b]] = k
        own = [True] * 256
        for t in range(256, len(self.left)):  # a token no text is encoded to can end no prefix
            own.append(own[self.left[t]] and own[self.right[t]] and self.apart(self.left[t], self.right[t], t - 256))
        #: Every end of a token, with the token's number if it is one itself.
        self.tails = {t[k:]: -1 for t in made for k in range(len(t))} | {t: x for t, x in made.items() if own[x]}
        self.longest = max(map(len, made))
        #: What ``_QUICK`` is not for: other characters, added tokens and runs of white space.
        self.odd = "|".join([rf"[^\x01-\x{{52f}}]|[{_NOT_QUICK}]|[{_SPACES}][{_SPACES}]", *[re.escape(t["content"]) for t in added]])
        self.many = _Many(self)
        self.beside: dict[int, bool] = {}
        self.known: dict[str, int] = {}

    def apart(self, u: int, t: int, until: int | None = None) -> bool:
        """No merge (before the merge ``until``) joins the last of u with the first of t while these are made.

        Undone from the last merge to the first, u shows its right and t its left part. A pair across the border joins if its merge comes before those
        that take its parts into larger ones; of equal merges the left one comes first."""
        u_goes = t_goes = len(self.rank) if until is None else until
        while True:
            k = self.rank.get((u, t))
            if k is not None and k < u_goes and k <= t_goes:
                return False
            if u > t and u >= 256:
                u_goes, u = u - 256, self.right[u]
            elif t >= 256:
                t_goes, t = t - 256, self.left[t]
            else:
                return True

    def prefixes(self, word: bytes, keep: array | None = None) -> int:
        """The tokens of ``word``; the counts of its prefixes of 1, 2, ... bytes are added to ``keep``."""
        tails, beside = self.tails, self.beside
        last, count, base = [0], [0], 0  # from ``base`` on: what stands further back than a token is long is forgotten
        for end in range(1, len(word) + 1):
            found, start = [], end - 1
            while start >= 0:
                t = tails.get(word[start:end])
                if t is None:
                    break
                if t >= 0:
                    found.append((t, start))
                start -= 1
            for t, start in reversed(found):
                if not start:
                    break
                u = last[start - base]
                fits = beside.get(pair := u << 32 | t)
                if fits is None:
                    if len(beside) >= MEMO:
                        beside.clear()
                    fits = beside[pair] = self.apart(u, t)
                if fits:
                    break
            last.append(t)
            count.append(count[start - base] + 1)
            if len(last) > 2 * self.longest + 8192:
                drop = len(last) - self.longest - 1
                if keep is not None:
                    keep.extend(count[1 if not base else 0 : drop])
                del last[:drop], count[:drop]
                base += drop
        if keep is not None:
            keep.extend(count[0 if base else 1 :])
        return count[-1]

    def words(self, section: str) -> list[str]:
        """A text without added tokens, cut as the library cuts it."""
        if not section:
            return []
        if max(section) < _SETTLED:
            return _CUT.findall(section)
        return [section[a:b] for _, (a, b) in self.library.pre_tokenize_str(section)]

    def _word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.prefixes(word.encode())
            if len(word) <= 64:
                if len(self.known) >= MEMO:
                    self.known.clear()
                self.known[word] = n
        return n

    def count(self, text: str) -> int:
        """The tokens of a text."""
        n, at = 0, 0
        for m in self.added.finditer(text):
            n += 1 + sum(map(self._word, self.words(text[at : m.start()])))
            at = m.end()
        return n + sum(map(self._word, self.words(text[at:] if at else text)))

    def text_prefixes(self, text: str) -> array:
        """The exact token count of the first 0, 1, 2, ... characters of a text, each as if the text ended there."""
        out, at = array("i", [0]), 0
        for m in [*self.added.finditer(text), None]:
            section = text[at : m.start()] if m else text[at:]
            base, start, full = out[-1], len(out) - 1, out[-1]
            words = self.words(section)
            white, behind = array("i"), ""  # counts inside the run of white space that is being read, and its last character
            begins, before = start, full  # of the last word, and the tokens in front of it
            for w in words:
                begins, before = len(out) - 1, full
                inner = array("i")
                full += self.prefixes(w.encode(), inner)
                ends = np.flatnonzero(np.array([(b & 0xC0) != 0x80 for b in w.encode()[1:]] + [True]))  # bytes that end a character
                if _WHITE.match(w) and not w.lstrip():
                    if not behind:
                        base = before
                    run = (behind + w).encode()
                    white = array("i")
                    self.prefixes(run, white)
                    ends = np.flatnonzero(np.array([(b & 0xC0) != 0x80 for b in run[1:]] + [True]))[len(behind) :]
                    out.extend(base + white[k] for k in ends)
                    behind += w
                    continue
                counts = [before + inner[k] for k in ends]
                if behind and _WHITE.match(w):  # the run's last space belongs to this word, but not if the text ends with it
                    white = array("i")
                    self.prefixes((behind + w[0]).encode(), white)
                    counts[0] = base + white[-1]
                if w in _PARTED:
                    counts[1] = before + self._word(w[0]) + self._word(w[1])
                behind = ""
                out.extend(counts)
            if not m:
                return out
            tail = text[begins : m.start()] if words else ""
            before = before if words else full
            special = m.group()
            out.extend(before + sum(map(self._word, self.words(tail + special[:r]))) for r in range(1, len(special)))
            out.append(full + 1)
            at = m.end()
        return out

    def _pieces(self, words: pa.Array) -> np.ndarray:
        """The tokens of each word behind a space: characters other than a space, of which the first and the last are not white.

        Two line ends between pieces are cut off as one word, as a piece begins with a space; nothing within these pieces is cut to just that."""
        n = np.zeros(len(words), np.int64)
        odd = pc.match_substring_regex(words, self.odd)
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            n[k] = self.count(" " + words[k].as_py())
        plain = words.filter(pc.invert(odd))
        if len(plain):
            cut = pa.array(_QUICK.findall(" " + "\n\n ".join(plain.to_numpy(zero_copy_only=False).tolist()))).dictionary_encode()
            each, at = self.many.tokens(cut.dictionary), cut.indices.to_numpy()
            between = at == pc.index(cut.dictionary, "\n\n").as_py()
            sums = np.cumsum(np.where(between, 0, each[at]))
            n[np.flatnonzero(pc.invert(odd).to_numpy(zero_copy_only=False))] = np.diff(np.append(sums[between], sums[-1]), prepend=0)
        return n

    def totals(self, texts: pa.Array) -> np.ndarray:
        """The tokens of each text. Texts are cut at single spaces between other characters, where the pattern always cuts, and each piece is counted once."""
        if not len(texts):
            return np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        flat = split.flatten().dictionary_encode()
        words, at = flat.dictionary, flat.indices.to_numpy()
        firsts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        begins, ends = (pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False) for p in _EDGES)
        cut = np.ones(len(at), bool)
        cut[1:] = ~(ends[at[:-1]] | begins[at[1:]])
        cut[firsts] = True
        first = np.zeros(len(at), bool)
        first[firsts] = True
        starts = np.flatnonzero(cut)
        size = np.diff(np.append(starts, len(at)))
        alone = (size == 1) & ~first[starts] & ~ends[at[starts]]
        used = np.zeros(len(words), bool)
        used[at[starts[alone]]] = True
        inner = np.zeros(len(words), np.int64)
        inner[used] = self._pieces(words.filter(pa.array(used)))
        n = np.where(alone, inner[at[starts]], 0)
        for k in np.flatnonzero(~alone).tolist():
            s = starts[k]
            joined = " ".join(words.take(pa.array(at[s : s + size[k]])).to_pylist())
            n[k] = self.count(joined if first[s] else " " + joined)
        return np.add.reduceat(n, np.searchsorted(starts, firsts))


class _Table:
    """Numbers by 64-bit keys: open addressing, many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]  # of several the last stays
            placed = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[placed]] = values[placed]
            left = np.setdiff1d(left, placed)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = self.values[slot]
        other = np.flatnonzero((there != keys) & (there != -1))
        out[there != keys] = -1
        while len(other):
            slot[other] = (slot[other] + 1) & self.mask
            there = self.keys[slot[other]]
            hit = there == keys[other]
            out[other[hit]] = self.values[slot[other[hit]]]
            other = other[~hit & (there != -1)]
        return out


class _Many:
    """The same dynamic program over many words at once, end by end."""

    SHORT = 64

    def __init__(self, vocabulary: Vocabulary):
        self.own = vocabulary
        numbers = {t: k for k, t in enumerate([b"", *vocabulary.tails])}
        self.token = np.array([-1, *vocabulary.tails.values()], np.int32)
        self.grow = _Table(np.array([numbers[t[1:]] << 8 | t[0] for t in vocabulary.tails], np.int64), np.array([numbers[t] for t in vocabulary.tails], np.int32))
        pairs = np.array(list(vocabulary.rank), np.int64)
        self.rank = _Table(pairs[:, 0] << 32 | pairs[:, 1], np.array(list(vocabulary.rank.values()), np.int32))
        self.left, self.right = np.array(vocabulary.left, np.int64), np.array(vocabulary.right, np.int64)
        #: Pairs met last, by hash: a pair takes the place of another.
        self.met, self.fits = np.full(MEMO, -1, np.int64), np.zeros(MEMO, bool)

    def apart(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """``Vocabulary.apart`` of each pair."""
        out = np.ones(len(u), bool)
        at = np.arange(len(u))
        u_goes = np.full(len(u), len(self.left), np.int64)
        t_goes = u_goes.copy()
        while len(at):
            k = self.rank.find(u << 32 | t)
            joins = (k >= 0) & (k < u_goes) & (k <= t_goes)
            out[at[joins]] = False
            by_u = (u > t) & (u >= 256)
            by_t = ~by_u & (t >= 256)
            u_goes, t_goes = np.where(by_u, u - 256, u_goes), np.where(by_t, t - 256, t_goes)
            u, t = np.where(by_u, self.right[u], u), np.where(by_t, self.left[t], t)
            on = ~joins & (by_u | by_t)
            at, u, t, u_goes, t_goes = at[on], u[on], t[on], u_goes[on], t_goes[on]
        return out

    def beside(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        pair = u << 32 | t
        slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO.bit_length() + 1)).astype(np.int64)
        out = self.fits[slot]
        new = np.flatnonzero(self.met[slot] != pair)
        if len(new):
            fresh, back = np.unique(pair[new], return_inverse=True)
            found = self.apart(fresh >> 32, fresh & 0xFFFFFFFF)
            out[new] = found[back]
            first = np.unique(slot[new], return_index=True)[1]  # one pair for each place
            self.met[slot[new[first]]], self.fits[slot[new[first]]] = pair[new[first]], out[new[first]]
        return out

    def tokens(self, words: pa.Array) -> np.ndarray:
        """The tokens of each word."""
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)
        size = np.diff(offsets)
        out = np.zeros(len(words), np.int64)
        for k in np.flatnonzero(size > self.SHORT).tolist():
            out[k] = self.own.prefixes(data[offsets[k] : offsets[k + 1]].tobytes())
        order = np.flatnonzero(size <= self.SHORT)
        order = order[np.argsort(-size[order], kind="stable")]  # longest first: the words that reach an end are the first ones
        if not len(order):
            return out
        begin = offsets[order]
        size = size[order]
        reach = len(size) - np.searchsorted(size[::-1], np.arange(size[0] + 1))  # words of at least so many bytes
        last, count = np.zeros((size[0] + 1, len(size)), np.int32), np.zeros((size[0] + 1, len(size)), np.int32)
        for end in range(1, size[0] + 1):
            rows, found = np.arange(reach[end]), []
            node = np.zeros(len(rows), np.int64)
            for start in range(end - 1, -1, -1):
                node = self.grow.find(node << 8 | data[begin[rows] + start])
                on = node >= 0
                rows, node = rows[on], node[on].astype(np.int64)
                if not len(rows):
                    break
                token = self.token[node]
                real = token >= 0
                found.append((start, rows[real], token[real]))
            undecided = np.ones(reach[end], bool)
            for start, rows, token in reversed(found):
                rows, token = (rows[on], token[on]) if not (on := undecided[rows]).all() else (rows, token)
                if start and len(rows):
                    on = self.beside(last[start, rows].astype(np.int64), token.astype(np.int64))
                    rows, token = rows[on], token[on]
                last[end, rows], count[end, rows] = token, count[start, rows] + 1
                undecided[rows] = False
        out[order] = count[size, np.arange(len(size))]
        return out


@lru_cache(maxsize=2)
def vocabulary(definition: str) -> Vocabulary:
    """One for each worker and definition: a task finds what the one before has learned."""
    return Vocabulary(definition)


def _read(model: str) -> str:
    with open(model, encoding="utf-8") as f:
        return f.read()


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return pc.fill_null(batch.column(1), "")


def counted(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Every row as doc_id, n_bytes, n_tokens, over_limit. ``model``: the path of a tokenizers file."""
    definition = _read(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(definition)
        for b in by_bytes(batches, 1, BATCH_BYTES):
            texts = _texts(b)
            n = known.totals(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def stored(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as doc_id and counts: the tokens of the first 0, 1, 2, ... characters of its text. Written as a table, it answers all later questions of length."""
    definition = _read(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(definition)
        for b in by_bytes(batches, 1, BATCH_BYTES):
            counts = pa.array([np.frombuffer(known.text_prefixes(t), np.int32) for t in _texts(b).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), counts], names=["doc_id", "counts"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, counts array<int>")


def total(counts: str = "counts") -> Column:
    """The tokens of the whole text."""
    return F.element_at(F.col(counts), -1).cast("long")


def longest_within(budget: int | Column, counts: str = "counts") -> Column:
    """The characters of the longest prefix of at most ``budget`` tokens; a longer prefix can have fewer tokens than a shorter one."""
    most = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.transform(F.reverse(counts), lambda n: n <= most)
    return (F.size(counts) - F.array_position(fits, True)).cast("long")
