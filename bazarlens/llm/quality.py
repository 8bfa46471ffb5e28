"""Quality by supervised subword embeddings.

Words and their character n-grams are hashed into a table of learnt vectors;
a word is the mean of its features, a text the mean of its words plus a
vector for the share of words that repeat the one before. A softmax over the
text vector gives the classes. Everything is linear up to the softmax, so a
trained table folds into one number per bucket for scoring.
"""

from __future__ import annotations

from collections import Counter
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
    """``sample`` bounds the labelled texts that the vectors are fitted on."""

    sample: int = 4000
    sizes: tuple[int, ...] = (3, 4, 5)
    bucket_bits: int = 16
    dims: int = 16
    epochs: int = 8
    rate: float = 2.0
    seed: int = 11
    threshold: float = 0.3


@dataclass
class Model:
    """Per bucket the difference of the two classes' outputs; the last entry is for repeats."""

    weights: np.ndarray
    bias: float


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _repeats(words: list[bytes]) -> float:
    return sum(map(bytes.__eq__, words, words[1:])) / len(words) if words else 0.0


def _counted(text: str | None) -> tuple[bytes, bytes, float]:
    """A whole text as its distinct words, how often each stands in it, and its share of repeats."""
    words = _words(text)
    counts = Counter(words)
    distinct = sorted(counts)
    return b" ".join(distinct), np.array([counts[w] for w in distinct], np.int32).tobytes(), _repeats(words)


def _features(words: bytes, counts: bytes, repeats: float, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and weights; the weights of the words add up to one."""
    distinct, times = words.split(), np.frombuffer(counts, np.int32)
    owner, hashes = subword_hashes(distinct, settings.sizes)
    each = times / max(times.sum(), 1) / np.maximum(np.bincount(owner, minlength=len(distinct)), 1)
    buckets, inverse = np.unique(hashes >> np.uint32(32 - settings.bucket_bits), return_inverse=True)
    weights = np.bincount(inverse, weights=each[owner], minlength=len(buckets))
    return np.append(buckets.astype(np.int64), 1 << settings.bucket_bits), np.append(weights, repeats).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Vectors from at most ``sample`` labelled texts outside the held-out fifth, the first by a hash of the id.

    Of an id that repeats one text counts, the least. A text comes to the
    driver as its distinct words and their counts.
    Without labels of both classes the model says that class for every text,
    or a chance of one half if there are none at all.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~is_held_out() & F.col("quality").isin(0, 1))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                words, counts, repeats = (list(x) for x in zip(*map(_counted, part.column(0).to_pylist()), strict=True))
                columns = [pa.array(words, pa.binary()), pa.array(counts, pa.binary()), pa.array(repeats, pa.float64()), part.column(1).cast(pa.int32())]
                yield pa.record_batch(columns, names=["words", "counts", "repeats", "y"])

    schema = "words binary, counts binary, repeats double, y int"
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    found = sample.select("text", "quality").mapInArrow(run, schema).toArrow().to_pydict()
    # Arrival order of the rows is not fixed; the order of what is learnt from is.
    samples = sorted(zip(found["words"], found["counts"], found["repeats"], found["y"], strict=True))
    return _fit(samples, settings)


def _fit(samples: list[tuple[bytes, bytes, float, int]], settings: Settings) -> Model:
    """Stochastic gradient descent; a text's features are made anew when it is its turn, as they take far more room."""
    size = (1 << settings.bucket_bits) + 1
    classes = {sample[3] for sample in samples}
    if len(classes) < 2:
        return Model(np.zeros(size), {0: -4.0, 1: 4.0}[classes.pop()] if classes else 0.0)
    generator = np.random.default_rng(settings.seed)
    vectors = generator.uniform(-1, 1, (size, settings.dims)).astype(np.float32) / settings.dims
    output, bias = np.zeros((settings.dims, 2), np.float32), np.zeros(2, np.float32)
    total, done = settings.epochs * len(samples), 0
    for _ in range(settings.epochs):
        for i in generator.permutation(len(samples)):
            words, counts, repeats, y = samples[i]
            buckets, weights = _features(words, counts, repeats, settings)
            rate = settings.rate * (1 - done / total)
            done += 1
            rows = vectors[buckets]
            hidden = weights @ rows
            logits = hidden @ output + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[y] -= 1
            back = output @ chance
            output -= rate * np.outer(hidden, chance)
            bias -= rate * 0.1 * chance
            vectors[buckets] = rows - rate * weights[:, None] * back
    return Model((vectors.astype(np.float64) @ (output[:, 1] - output[:, 0]).astype(np.float64)), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts; remembers the number of each word."""

    def __init__(self, model: Model, settings: Settings, limit: int = 400_000):
        self.model, self.settings, self.limit = model, settings, limit
        self.known: dict[bytes, float] = {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known = {}
        words = [_words(x) for x in texts]
        new = list(set().union(*words).difference(self.known))
        if new:
            owner, hashes = subword_hashes(new, self.settings.sizes)
            value = self.model.weights[(hashes >> np.uint32(32 - self.settings.bucket_bits)).astype(np.int64)]
            mean = np.bincount(owner, weights=value, minlength=len(new)) / np.bincount(owner, minlength=len(new))
            self.known.update(zip(new, mean.tolist(), strict=True))
        total = np.array([sum(map(self.known.__getitem__, x)) / len(x) + self.model.weights[-1] * _repeats(x) if x else 0.0 for x in words])
        return 1 / (1 + np.exp(-np.clip(total + self.model.bias, -30, 30)))


def score_texts(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= threshold) for every row.

    A null, empty or blank text has no words and gets the score of the bias
    alone. A null id counts as held out. Repeated rows get the same score each;
    other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, settings)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.record_batch([part.column(0), pa.array(scorer.scores(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(is_held_out(), F.lit(True)).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose text scores at least the threshold, with all their columns."""
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, settings)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield part.filter(pa.array(scorer.scores(part.column(column).to_pylist()) >= settings.threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
