"""Toxicity by non-negative positive-unlabelled learning.

Only texts confirmed as toxic and texts without any label are learnt from.
The share of toxic texts among the unlabelled (the class prior) corrects the
risk of calling an unlabelled text harmless; that part of the risk cannot be
negative, so when it falls below zero it is raised again instead of lowered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlens.llm.common import is_held_out
from bazarlens.llm.subwords import subword_hashes


@dataclass(frozen=True)
class Settings:
    """``positives`` and ``unlabelled`` bound the sample that the model is fitted on."""

    positives: int = 3000
    unlabelled: int = 6000
    sizes: tuple[int, ...] = (5, 6)
    bucket_bits: int = 20
    features: int = 500
    least_texts: int = 3
    least_distance: float = 5.0
    epochs: int = 400
    rate: float = 0.05
    decay: float = 1e-3


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def _words(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(None, b".,;:!?\"()").split())


def _text_buckets(text: str | None, settings: Settings) -> np.ndarray:
    """Distinct feature buckets of a whole text."""
    _, hashes = subword_hashes(list(_words(text)), settings.sizes)
    return np.unique(hashes >> np.uint32(32 - settings.bucket_bits)).astype(np.int32)


def _sample_features(rows: DataFrame, settings: Settings) -> list[np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                found = [_text_buckets(x, settings).tobytes() for x in batch.slice(start, 500).column(0).to_pylist()]
                yield pa.record_batch([pa.array(found, pa.binary())], names=["f"])

    # One text per id: an id may repeat without bound.
    texts = rows.groupBy("doc_id").agg(F.min("text").alias("text")).select("text")
    return [np.frombuffer(r["f"], np.int32) for r in texts.mapInArrow(run, "f binary").toLocalIterator()]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A linear model from a bounded sample: the first rows by a hash of the id.

    Positives are texts with a label ``toxic`` = 1 outside the held-out fifth;
    unlabelled are rows of ``docs`` whatever their labels say. Of an id that
    repeats one text counts, the least; a text comes to the driver as the numbers of its
    distinct features, ``2^bucket_bits`` at most. The class prior
    is the share of ones among the labels outside the held-out fifth. Without
    any positive the model calls nothing toxic.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~is_held_out() & F.col("toxic").isNotNull())
    prior = known.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0] or 0.0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND length(text) > 0")
    pick = lambda rows, n, salt: rows.orderBy(F.xxhash64("doc_id", F.lit(salt)), "text").limit(n)
    chosen = pick(texts.join(known.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lit("").alias("text")).distinct(), settings.positives, 1)
    positive = _sample_features(texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"), settings)
    chosen = pick(texts.select("doc_id", F.lit("").alias("text")), settings.unlabelled, 2)
    unlabelled = _sample_features(texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi"), settings)
    # Arrival order of the rows is not fixed; the order of what is learnt from is.
    positive.sort(key=bytes)
    unlabelled.sort(key=bytes)
    return _fit(positive, unlabelled, prior, settings)


def _fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, settings: Settings) -> Model:
    empty = Model(np.zeros(0, np.int64), np.zeros(0), -6.0)
    if not positive or not unlabelled or not 0 < prior < 1:
        return empty
    size = 1 << settings.bucket_bits
    in_p = np.bincount(np.concatenate(positive), minlength=size)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=size)
    share_p, share_u = in_p / len(positive), in_u / len(unlabelled)
    # The share among harmless texts follows from the other two and the prior.
    share_n = np.clip((share_u - prior * share_p) / (1 - prior), 0, 1)
    usual = np.maximum(share_u, 1 / len(unlabelled))
    spread = np.sqrt(usual * (1 - np.minimum(usual, 0.99)) * (1 / len(positive) + 1 / len(unlabelled)))
    distance = np.where(in_p >= max(settings.least_texts, 0.01 * len(positive)), (share_p - share_n) / spread, 0.0)
    order = np.lexsort((np.arange(size), -distance))[: settings.features]
    buckets = np.sort(order[distance[order] > settings.least_distance])
    if not len(buckets):
        return empty
    place = np.full(size, -1, np.int64)
    place[buckets] = np.arange(len(buckets))

    def sparse(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        found = [place[x] for x in texts]
        found = [x[x >= 0] for x in found]
        return np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found), len(found)

    p, u = sparse(positive), sparse(unlabelled)
    weights, bias = np.zeros(len(buckets)), float(np.log(prior / (1 - prior)))
    first, second, steps = np.zeros(len(buckets) + 1), np.zeros(len(buckets) + 1), 0
    for _ in range(settings.epochs):
        score = lambda x: np.bincount(x[0], weights=weights[x[1]], minlength=x[2]) + bias
        chance_p, chance_u = 1 / (1 + np.exp(-score(p))), 1 / (1 + np.exp(-score(u)))
        # Log loss: of calling a positive harmful, and of calling either sample harmless.
        harmless = -np.log1p(-np.minimum(chance_u, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(chance_p, 1 - 1e-12)).mean()
        slope_p, slope_u = prior * (chance_p - 1) / p[2], np.zeros(u[2])
        correction_p, correction_u = -prior * chance_p / p[2], chance_u / u[2]
        if harmless >= 0:
            slope_p, slope_u = slope_p + correction_p, correction_u
        else:
            slope_p, slope_u = -correction_p, -correction_u
        gradient = np.bincount(p[1], weights=slope_p[p[0]], minlength=len(buckets)) + np.bincount(u[1], weights=slope_u[u[0]], minlength=len(buckets)) + settings.decay * weights
        gradient = np.append(gradient, slope_p.sum() + slope_u.sum())
        steps += 1
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = settings.rate * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.99**steps)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return Model(buckets, weights, bias)


class Scorer:
    """Scores texts; remembers which of a word's features count."""

    def __init__(self, model: Model, settings: Settings, limit: int = 300_000):
        self.model, self.settings, self.limit = model, settings, limit
        self.place = np.full(1 << settings.bucket_bits, -1, np.int32)
        self.place[model.buckets] = np.arange(len(model.buckets))
        self.known: dict[bytes, tuple] = {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known = {}
        words = [_words(x) for x in texts]
        new = list(set().union(*words).difference(self.known))
        owner, hashes = subword_hashes(new, self.settings.sizes)
        found = self.place[(hashes >> np.uint32(32 - self.settings.bucket_bits)).astype(np.int64)]
        used = np.flatnonzero(found >= 0)
        self.known.update(dict.fromkeys(new, ()))
        for word, feature in zip(owner[used].tolist(), found[used].tolist(), strict=True):
            self.known[new[word]] += (feature,)
        result = []
        for some in words:
            features = set().union(*filter(None, map(self.known.__getitem__, some)))
            total = self.model.bias + float(np.sum(self.model.weights[sorted(features)])) if features else self.model.bias
            result.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
        return np.array(result)


def score_texts(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) for every row.

    A null or empty text gets the score of a text without any known feature.
    A null id counts as held out. Repeated rows get the same score each; other
    columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, settings)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.record_batch([part.column(0), pa.array(scorer.scores(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(is_held_out(), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
