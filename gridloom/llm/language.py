"""Language ID by hierarchical discrimination: the family first, then the language within it.

Both levels use one-versus-one linear support vector machines over the shares of hashed
character n-grams: between families, and between the languages of one family. The machine
of a pair votes; most votes win, equal votes go to the larger sum of margins, then to the name
that sorts first. The score is the product of the two winners' logistic weakest margins.

Training takes about ``rows_per_language`` rows of each language, those whose id hashes below the
share needed, with their whole texts. Every text is classified whole.

Defined results: ``und`` with score 0 where a text is null or has no letter. A language without
relatives in FAMILIES is a family of its own. With one language in training, every text with a
letter is that language, score 1; with none, every text is ``und``. Several texts of one id and language: the one
with the smallest hash is learned from. Repeated rows are classified alike. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, slices, text_bytes
from .subwords import WordSums, bag_of, collected_bags

#: Families of languages, by language code.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "fi": "uralic", "hu": "uralic", "et": "uralic",
}


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    rows_per_language: int = 400
    epochs: int = 12
    penalty: float = 1e-4
    seed: int = 11


def _has_no_letter(word: bytes) -> bool:
    return not word.isalpha() and not any(map(str.isalpha, word.decode("utf-8")))


def _bag(text: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    return bag_of(Counter({w: n for w, n in Counter(text.split()).items() if not _has_no_letter(w)}), s.sizes, s.bits, whole=False, fold=True)


SCALE = 12.0  # brings shares of n-grams to vectors of about unit length


def svm(bags: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Averaged subgradient steps on the hinge loss; both sides weigh the same."""
    w, b, mean_w, mean_b, t = np.zeros(1 << s.bits), 0.0, np.zeros(1 << s.bits), 0.0, 0
    rng = np.random.default_rng(s.seed)
    weight = {v: len(signs) / (2 * max(1, (signs == v).sum())) for v in (-1, 1)}
    scale, steps = 1.0, 0
    for epoch in range(s.epochs):
        for k in rng.permutation(len(bags)):
            t += 1
            rate = 1 / (s.penalty * (t + 1000 / s.penalty / 1e4 + 1 / s.penalty))
            ids, share = bags[k]
            x = share * SCALE
            scale *= 1 - rate * s.penalty
            if signs[k] * (scale * (w[ids] @ x) + b) < 1:
                step = rate * weight[signs[k]] * signs[k]
                w[ids] += step / scale * x
                b += step * 0.1
        if epoch >= s.epochs // 2:
            mean_w, mean_b, steps = mean_w + scale * w, mean_b + b, steps + 1
    return mean_w / steps * SCALE, mean_b / steps


@dataclass(frozen=True)
class Model:
    """``pairs``: (level, first, second) of each machine, level ``""`` for families; weights and biases in that order."""

    languages: tuple[str, ...]
    families: dict[str, str]
    pairs: tuple[tuple[str, str, str], ...]
    weights: np.ndarray
    biases: np.ndarray
    settings: Settings

    def _winner(self, level: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index in ``names`` and weakest margin of the winner for each text."""
        n = margins.shape[1]
        votes, total, weakest = np.zeros((len(names), n)), np.zeros((len(names), n)), np.full((len(names), n), np.inf)
        for m, (at, a, b) in zip(margins, self.pairs, strict=True):
            if at == level:
                for name, own in ((names.index(a), m), (names.index(b), -m)):
                    votes[name] += own >= 0 if name == names.index(a) else own > 0
                    total[name] += own
                    weakest[name] = np.minimum(weakest[name], own)
        best = np.lexsort((-np.arange(len(names))[:, None] * np.ones(n), total, votes), axis=0)[-1]
        return best, weakest[best, np.arange(n)]

    def predictor(self) -> Callable[[list[bytes]], tuple[list[str], np.ndarray]]:
        s = self.settings
        words = WordSums(self.weights if len(self.weights) else np.zeros((1, 1 << s.bits)), s.sizes, s.bits, whole=False, fold=True, skip=_has_no_letter)
        families = sorted(set(self.families.values()))
        within = {f: sorted(x for x in self.languages if self.families[x] == f) for f in families}
        sure = lambda m: np.where(np.isinf(m), 1.0, 1 / (1 + np.exp(-np.clip(4 * m, -30, 30))))

        def predict(texts: list[bytes]) -> tuple[list[str], np.ndarray]:
            sums, count = words.score(texts)
            if not self.languages:
                return ["und"] * len(texts), np.zeros(len(texts))
            margins = (sums / np.maximum(count, 1))[: len(self.pairs)] + self.biases[:, None]
            family, margin = self._winner("", families, margins)
            score, said = sure(margin), np.empty(len(texts), dtype=object)
            for f, name in enumerate(families):
                rows = family == f
                if rows.any():
                    best, inner = self._winner(name, within[name], margins[:, rows])
                    said[rows] = np.array(within[name], dtype=object)[best]
                    score[rows] *= sure(inner)
            said[count == 0] = "und"
            score[count == 0] = 0.0
            return said.tolist(), score

        return predict


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], s: Settings = Settings(), families: dict[str, str] = FAMILIES) -> Model:
    used = [k for k, (ids, _) in enumerate(bags) if len(ids)]
    languages = tuple(sorted({langs[k] for k in used}))
    family = {x: families.get(x, x) for x in languages}
    groups = sorted(set(family.values()))
    pairs = [("", a, b) for a, b in combinations(groups, 2)]
    pairs += [(g, a, b) for g in groups for a, b in combinations([x for x in languages if family[x] == g], 2)]
    weights, biases = [], []
    for level, a, b in pairs:
        of = (lambda k: family[langs[k]]) if level == "" else (lambda k: langs[k])
        rows = [k for k in used if of(k) in (a, b)]
        w, c = svm([bags[k] for k in rows], np.array([1 if of(k) == a else -1 for k in rows]), s)
        weights.append(w)
        biases.append(c)
    return Model(languages, family, tuple(pairs), np.array(weights, np.float32).reshape(len(pairs), 1 << s.bits), np.array(biases), s)


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from the rows of ``docs`` with a language: of each the ids of the smallest hashes, ``rows_per_language`` at most, however many rows an id has."""
    known = docs.filter("lang is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label"), F.col("text").cast("string").alias("text"))
    known = known.filter("text is not null")
    ids = scratch(known.select("label", "doc_id").distinct(), "language-ids")
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = ids.groupBy("label").agg(F.count("*").alias("n"))
    few = ids.join(F.broadcast(counts), "label").filter(low < 3.0 * s.rows_per_language / F.col("n"))  # about three times as many as wanted
    place = F.row_number().over(Window.partitionBy("label").orderBy(low, "doc_id"))
    ids = few.select("label", "doc_id", place.alias("place")).filter(F.col("place") <= s.rows_per_language).drop("place")
    bags, langs = collected_bags(known.join(F.broadcast(ids), ["label", "doc_id"]), partial(_bag, s=s))  # at most rows_per_language ids a language
    return train(bags, langs, s)


def _predicted(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model.predictor()
        for batch in slices(batches):
            said, score = predict(text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double")


def _identified(model: Model, at: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model.predictor()
        for batch in slices(batches):
            said, score = predict(text_bytes(batch.column(at).cast(pa.string())))
            yield batch.filter(pa.array([x != "und" for x in said]) if not least else pa.array([x != "und" and v >= least for x, v in zip(said, score, strict=True)]))

    return run


def keep_identified(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, whole, that have a language with at least this score."""
    return docs.mapInArrow(_identified(model, docs.columns.index("text"), least), docs.schema)
