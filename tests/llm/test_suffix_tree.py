"""The suffix tree against a plain version that holds everything in dictionaries."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from gridloom.llm import suffix_tree
from gridloom.llm.suffix_tree import LETTERS, Model, Settings, letter_model, score_documents

END = b"\n"


def tokens_of(text):
    return (text or "").encode().lower().split() + [END]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Plain:
    def __init__(self, texts, s=Settings()):
        self.s = s
        self.texts = [tokens_of(t) for t in texts]
        self.count = Counter(w for t in self.texts for w in t)
        self.n = sum(self.count.values())
        pairs = Counter()
        for w in self.count.keys() - {END}:
            pairs.update(a * LETTERS + b for a, b in zip([256, *w], [*w, 256], strict=True))
        self.letters = letter_model(pairs)
        self.next = Counter()  # (context, word)
        self.seen = Counter()
        for t in self.texts:
            whole = [END, *t]
            for k in range(1, len(whole)):
                for depth in range(1, min(k, 12) + 1):
                    self.next[tuple(whole[k - depth : k]), whole[k]] += 1
                    self.seen[tuple(whole[k - depth : k])] += 1
        self.by_context = {}
        for (c, w), n in self.next.items():
            if n >= s.least:
                self.by_context.setdefault(c, {})[w] = n
        self.known = {}

    def spelled(self, w):
        return sum(self.letters[a * LETTERS + b] for a, b in zip([256, *w], [*w, 256], strict=True))

    def base(self, w):
        d = self.s.discount
        if not self.n:
            return math.log(0.5) + (0 if w == END else self.spelled(w))
        mass = d * len(self.count) / self.n
        if not self.count[w]:
            return math.log(mass) + self.spelled(w)
        return math.log((self.count[w] - d) / self.n + (0 if w == END else mass * math.exp(self.spelled(w))))

    def tried(self, c):
        if self.seen[c] < self.s.least:
            return False
        return len(c) == 1 or (self.kept(c[1:]) and self.tried(c[:-1]) and self.by_context.get(c[:-1], {}).get(c[-1], 0) >= self.s.least)

    def kept(self, c):
        if c not in self.known:
            self.known[c] = self._kept(c)
        return self.known[c]

    def _kept(self, c):
        if not self.tried(c):
            return False
        d, own, total = self.s.discount, {w: n for w, n in self.by_context.get(c, {}).items() if self.stored(c[1:], w)}, self.seen[c]
        if not own:
            return False
        back = 1 - sum(n - d for n in own.values()) / total
        gain = sum(n * (math.log((n - d) / total) + suffix_tree.OCTAVES[np.abs(suffix_tree.OCTAVES + self.prob(c[1:], w) / math.log(2)).argmin()] * math.log(2)) for w, n in own.items())
        return gain + (total - sum(own.values())) * math.log(back) >= 0.5 * len(own) * math.log(total)

    def stored(self, c, w):
        return self.count[w] >= self.s.least if not c else self.by_context.get(c, {}).get(w, 0) >= self.s.least

    def prob(self, c, w):
        if not c:
            return self.base(w)
        lower = self.prob(c[1:], w)
        if not self.kept(c):
            return lower
        own, d, total = self.by_context[c], self.s.discount, self.seen[c]
        back = 1 - sum(n - d for n in own.values()) / total
        return math.log(max(own.get(w, 0) - d, 0) / total + back * math.exp(lower)) if lower > -600 or w in own else math.log(back) + lower

    def score(self, text):
        whole = [END, *tokens_of(text)]
        return sum(self.prob(tuple(whole[max(0, k - 12) : k]), whole[k]) for k in range(1, len(whole))) / math.log(10)


def corpus():
    lines = ["the cat sat on the mat and the dog sat on the rug", "the dog ate the bone that the cat hid under the rug", "a bird sang in the tree while the cat sat on the mat", "one two three four five six seven eight nine ten"]
    rows = [(k, " ".join(lines[(k * 7 + j * k) % 4] if (k + j) % 3 else lines[j % 4].replace("the", f"the{k % 5}") for j in range(3))) for k in range(60)]
    return [*rows, (60, None), (61, ""), (62, " \t\n"), (63, "Zyzzyva ÄÖ unseen" + "q" * 3000), (None, "no id the cat sat"), (7, rows[7][1]), (7, rows[7][1]), (65, "x"), *((100 + k, f"{'pd'[k % 2]} q r {'xy'[k % 2]}") for k in range(40)), *((200 + k, "s r z") for k in range(40))]


@pytest.mark.parametrize("s", [Settings(), Settings(block_bytes=600, part_tokens=40, part_bytes=4000)])
def test_scores_as_plain_tree(spark, s):
    """One block and part, and many blocks, parts, split contexts and spool files."""
    rows = corpus()
    plain = Plain([t for i, t in rows if not held_out(i)])
    out = score_documents(spark.createDataFrame(rows, "doc_id long, text string"), s).collect()
    assert len(out) == len(rows)
    want = sorted((str(i), held_out(i), len(tokens_of(t)), sum(plain.count[w] > 0 for w in tokens_of(t)), plain.n, sum(math.log10((plain.count[w] + 1) / (plain.n + len(plain.count) + 1)) for w in tokens_of(t)), plain.score(t)) for i, t in rows)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-6)
    assert max(len(c) for c, kept in plain.known.items() if kept) >= 3  # deeper than two


def test_words_seen_and_spelled_sum_to_one():
    """Known words, and all spelled words of up to three letters of a small alphabet plus what is longer."""
    plain = Plain([t for _, t in corpus()])
    contexts = [(), ("the".encode(),), ("sat".encode(), b"on"), (b"cat", b"sat", b"on"), (END,)]
    for c in contexts:
        known = sum(math.exp(plain.prob(c, w)) for w in plain.count)
        unseen = [bytes([a]) for a in range(256)] + [bytes([a, b]) for a in range(97, 123) for b in range(97, 123)] + [b"qqzz", b"unseen"]
        spelled = sum(math.exp(plain.prob(c, w)) for w in unseen if not plain.count[w])
        assert 0.5 < known < known + spelled <= 1 + 1e-9


def test_spelling_is_a_distribution():
    m = Model(Settings(), 1)
    assert m.letters.reshape(LETTERS, LETTERS).shape == (257, 257)
    import numpy as np

    assert np.allclose(np.exp(letter_model({97 * LETTERS + 98: 5}).reshape(LETTERS, LETTERS)).sum(axis=1), 1)


@pytest.mark.parametrize("rows", [[], [(1, "one document that is held out or not")], [(2, None)]])
def test_small_tables(spark, rows):
    out = score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in out] == [i for i, _ in rows]
    plain = Plain([t for i, t in rows if not held_out(i)])
    for r, (_, t) in zip(out, rows, strict=True):
        assert r.score == pytest.approx(plain.score(t))


def test_only_held_out_rows(spark):
    """Without training rows the end has one half and spelled words the other."""
    i = next(k for k in range(100) if held_out(k))
    r = score_documents(spark.createDataFrame([(i, "ab")], "doc_id long, text string")).first()
    assert r.train_tokens == 0 and r.n_known == 0
    assert r.score == pytest.approx(2 * math.log10(0.5) - 3 * math.log10(LETTERS))


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    words = [bytes([a, b]) for a in range(256) for b in range(256)] + [bytes([a]) for a in range(256)] + [b"a" * n for n in range(3, 3000)]
    h = suffix_tree.word_hashes(pa.array(words, pa.binary()))
    assert len(set(h.tolist())) == len(words)


def test_rounded_probabilities_have_no_floor_that_a_corpus_can_reach():
    octaves = np.concatenate([np.linspace(0, 16, 500), np.linspace(16, 79, 500)])
    back = suffix_tree.OCTAVES[suffix_tree.rounded_octaves(2.0**-octaves)]
    assert np.abs(back - octaves)[:500].max() <= 1 / 16 + 1e-9 and np.abs(back - octaves).max() <= 0.51
    assert (np.diff(suffix_tree.OCTAVES) > 0).all() and len(suffix_tree.OCTAVES) == 256
