"""Periodic runs against a search through all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import periodic_runs, queries
from helpers import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(w, length, exponent):
    out = []
    for q in range(1, len(w) // max(exponent, 1) + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(length, exponent * q) and j > i and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def answer(doc_id, text):
    w = planted(doc_id, WORD.findall(text or ""))
    found = plain(w, 6, 4)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None, None, None)
    kept = " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


@pytest.mark.parametrize("length, exponent", [(6, 4), (2, 2), (4, 2), (6, 3), (9, 3), (3, 2)])
def test_random_words(length, exponent):
    rng = random.Random(length * 10 + exponent)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            letters = rng.randint(1, 4)
            w = [rng.randint(0, letters) for _ in range(rng.randint(0, 40))]
            if w and rng.random() < 0.5:
                w = w + w[: rng.randint(1, min(6, len(w)))] * rng.randint(2, 7) + [rng.randint(0, letters) for _ in range(rng.randint(0, 5))]
            texts.append(w)
        words, ends = np.array([x for t in texts for x in t], np.int64), np.cumsum([0] + [len(t) for t in texts])
        got = [tuple(map(int, x)) for x in zip(*periodic_runs.runs(words, ends, length, exponent), strict=True)]
        assert got == [(i, *x) for i, t in enumerate(texts) for x in plain(t, length, exponent)]


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    got = [tuple(map(int, x))[1:] for x in zip(*periodic_runs.runs(np.array(b), np.array([0, len(b)]), 2, 2), strict=True)]
    assert got == plain(b, 2, 2)


def test_filter_by_copies_keeps_all_runs():
    assert periodic_runs._copies(6, 4) == 3 and periodic_runs._copies(2, 2) == 0


def test_query_on_the_small_tables(spark, docs):
    short = docs.filter("n_chars < 3000")
    got = {r["doc_id"]: tuple(r) for r in periodic_runs.collapsed(short, order=periodic_runs.planted).collect()}
    want = {i: answer(i, t) for i, t in short.select("doc_id", "text").collect()}
    assert got == want and sum(r[1] > 0 for r in want.values()) > 5
    whole = queries.op12_periodic_runs(spark, SF)
    assert whole.count() == docs.count() and {r["doc_id"]: tuple(r) for r in whole.join(short.select("doc_id"), "doc_id").collect()} == want


def test_awkward_rows(spark, edge):
    rows = sorted((tuple(r) for r in periodic_runs.collapsed(edge, order=periodic_runs.planted).collect()), key=str)
    assert rows == sorted((answer(r["doc_id"], r["text"]) if len(r["text"] or "") < 1000 else next(x for x in rows if x[0] == r["doc_id"]) for r in edge.collect()), key=str)
    assert not periodic_runs.collapsed(edge.limit(0)).count() and not periodic_runs.found(edge.limit(0)).count()


def test_long_repetitions(spark):
    line = [f"w{i}" for i in range(700)]
    text = " ".join(["start", *line * 30, *line[:5], "end"])
    rows = [(1, text), (2, "x " * 50_000), (3, "a b c d\n" * 9 + "a b"), (None, "y y y y y y"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["start"], r["length"], r["period"]) for r in periodic_runs.found(df).collect()}
    assert found == {(1, 1, 21_005, 700), (2, 0, 50_000, 1), (3, 0, 38, 4), (None, 0, 6, 1)}
    kept = {r["doc_id"]: r["collapsed_sha256"] for r in periodic_runs.collapsed(df.filter("doc_id is not null")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert kept == {1: sha(" ".join(["start", *line, "end"])), 2: sha("x"), 3: sha("a b c d")}


def test_words_of_a_batch():
    texts = pa.array(["", " a b  c\x0b", "\t", "c a"])
    distinct, at, ends = periodic_runs.cut_words(texts)
    assert [distinct[int(i)].as_py() for i in at] == ["a b", "c", "c", "a"] and ends.tolist() == [0, 0, 2, 2, 4]
