"""Token counts of texts and of all their prefixes against the library."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import token_counts

PATH = public_tokenizers.path(token_counts.MODEL)
ATOMS = ["a", "the", "don't", "'re", "'ll", "'ve we", "'", "'s", "  ", " ", "\n", "\t", "\r\n", " ", "　", " ", "\x1c", "\x85", "<|endoftext|>", "<|endof", "x" * 30, "aaaa", "123", "4", "!!", "?!", "---", "é", "ß", "日本", "😀", "՘a", "²", "½", "hello", "World", "http://", " word", " is", "\n\n", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def known():
    with open(PATH, encoding="utf-8") as f:
        return token_counts.vocabulary(f.read())


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix(library, known):
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 12)))
        assert list(known.text_prefixes(text)) == lengths(library, [text[:i] for i in range(len(text) + 1)]), repr(text)


def test_whole_texts(library, known):
    rng = random.Random(2)
    texts = ["".join(rng.choice([*ATOMS, " ", " "]) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    assert known.totals(pa.array(texts)).tolist() == lengths(library, texts)
    assert known.totals(pa.array([], pa.string())).tolist() == []


def test_documents(spark, docs, library):
    rows = {i: t or "" for i, t in docs.select("doc_id", "text").collect()}
    n = dict(zip(rows, lengths(library, list(rows.values())), strict=True))
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.counted(docs, PATH).collect()}
    assert got == {i: (len(t.encode()), n[i], n[i] > 512) for i, t in rows.items()}


def test_long_words_in_windows(library, known):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcehtino") for _ in range(30_000)), "ab" * 9000, "é" * 5000]
    assert [known.count(w) for w in words] == lengths(library, words)
    counts = known.text_prefixes(words[0])
    assert [counts[k] for k in (8191, 8192, 8200, 16_500, 29_999)] == lengths(library, [words[0][:k] for k in (8191, 8192, 8200, 16_500, 29_999)])


def test_stored_counts_answer_budgets(spark, library):
    texts = ["The cat don't sit, they're asleep.  \n Again and again", "'rearrange", "", None, "one<|endoftext|>two", "xyzzy " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = token_counts.stored(df, PATH)
    for budget in (0, 1, 3, 7, 1000):
        got = {r["doc_id"]: (r["n"], r["most"]) for r in stored.select("doc_id", token_counts.total().alias("n"), token_counts.longest_within(budget).alias("most")).collect()}
        for i, t in enumerate(texts):
            own = lengths(library, [(t or "")[:k] for k in range(len(t or "") + 1)])
            assert got[i] == (own[-1], max(k for k, n in enumerate(own) if n <= budget))
    by_row = stored.select("doc_id", token_counts.longest_within(F.col("doc_id")).alias("most")).collect()
    assert len(by_row) == len(texts)


def test_awkward_rows(spark, edge, library):
    rows = sorted((tuple(r) for r in token_counts.counted(edge, PATH).collect()), key=str)
    texts = [(r["doc_id"], r["text"] or "") for r in edge.collect()]
    want = [(i, len(t.encode()), n, n > 512) for (i, t), n in zip(texts, lengths(library, [t for _, t in texts]), strict=True)]
    assert rows == sorted(want, key=str)
    assert not token_counts.counted(edge.limit(0), PATH).count() and not token_counts.stored(edge.limit(0), PATH).count()


def test_other_encoders_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        token_counts.Vocabulary(f.read())
