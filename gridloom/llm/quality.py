"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words, repeated words and character
n-grams; softmax over the two labels. Trained by stochastic gradient descent in numpy, with a step per vector that
shrinks with its past gradients. As both layers are linear up to the softmax, scoring needs
one number for each feature: its vector's product with the difference of the output rows.

Training takes at most ``rows_per_label`` labelled rows of each label, those with the smallest
hash of their id, of which it learns whole texts; the output bias is then shifted to the
labels' true shares. Every text is scored whole.

Defined results: null and empty texts have no features and get the bias alone. Several label rows
of one id: the smallest label counts. Several texts of one id: the one with the smallest hash is learned from. Null ids or labels are not learned from. Where only
one label or none occurs, all scores are the labels' share (0.5 without labels). Ties in a score
need no rule. Repeated rows are scored alike. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes
from .subwords import WordSums, bag_of, collected_bags


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (2, 3, 4)
    bits: int = 16
    dims: int = 12
    epochs: int = 8
    rate: float = 0.25
    rows_per_label: int = 1200
    seed: int = 7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    settings: Settings

    def scorer(self) -> Callable[[list[bytes]], np.ndarray]:
        s = self.settings
        words = WordSums(self.weights[None, :], s.sizes, s.bits, whole=True, fold=False, same=1 << s.bits)

        def score(texts: list[bytes]) -> np.ndarray:
            sums, count = words.score(texts)
            return 1 / (1 + np.exp(-np.clip(sums[0] / np.maximum(count, 1) + self.bias, -30, 30)))

        return score


def _bag(text: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    tokens = text.split()
    repeats = sum(map(eq, tokens, tokens[1:]))
    return bag_of(Counter(tokens), s.sizes, s.bits, whole=True, fold=False, extra={1 << s.bits: repeats} if repeats else None)  # words that repeat the one before have a bucket of their own


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], share: float, s: Settings = Settings()) -> Model:
    """``bags``: distinct buckets of each text and their shares; ``share``: true share of label 1, which the score's bias is set to."""
    if len(set(labels)) < 2:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros((1 << s.bits) + 1, np.float32), float(np.log(p / (1 - p))), s)
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dims, 1 / s.dims, ((1 << s.bits) + 1, s.dims)).astype(np.float32)
    out, bias = np.zeros((2, s.dims), np.float32), np.zeros(2, np.float32)
    seen, seen_out, seen_bias = np.full((1 << s.bits) + 1, 1e-8, np.float32), np.full(2, 1e-4, np.float32), np.full(2, 1e-2, np.float32)
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        for k in rng.permutation(len(bags)):
            ids, part = bags[k]
            part = part.astype(np.float32)
            hidden = part @ vectors[ids] if len(ids) else np.zeros(s.dims, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = p @ out
            step = np.outer(p, hidden)
            seen_out += (step**2).mean(axis=1)
            seen_bias += p**2
            if len(ids) and (size := float(back @ back)) > 0:
                seen[ids] += part**2 * size / s.dims
                vectors[ids] -= rate * (part / np.sqrt(seen[ids]))[:, None] * back
            out -= rate * step / np.sqrt(seen_out)[:, None]
            bias -= rate * p / np.sqrt(seen_bias)
    had = np.mean(labels)
    p = min(max(share, 1e-6), 1 - 1e-6)
    shift = np.log(p / (1 - p)) - np.log(had / (1 - had))
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0] + shift), s)


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int], float]:
    """A bounded sample of labelled texts as bags, and the share of label 1 among all labelled ids given."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    share = known.agg(F.avg("label").alias("p")).first()["p"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.xxhash64("doc_id")
    parts = [known.filter(F.col("label") == q).orderBy(order, "doc_id").limit(s.rows_per_label) for q in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * rows_per_label ids
    bags, found = collected_bags(texts.filter("text is not null").join(sample, "doc_id"), partial(_bag, s=s))
    return bags, [int(x) for x in found], 0.5 if share is None else float(share)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    return train(*training_rows(docs, labels, s), s)


def _scored(model: Model, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in slices(batches):
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score(text_bytes(batch.column(at))), pa.float64())], names=[*names, "score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_scored(model, 1), "doc_id long, score double")


def _passing(model: Model, at: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in slices(batches):
            yield batch.filter(pa.array(score(text_bytes(batch.column(at).cast(pa.string()))) >= least))

    return run


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, whole, whose score is at least ``least``."""
    return docs.mapInArrow(_passing(model, docs.columns.index("text"), least), docs.schema)
