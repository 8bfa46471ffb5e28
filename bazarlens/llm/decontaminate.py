"""Benchmark passages in documents, found by latent semantic retrieval.

TF-IDF vectors of the benchmark's passages are factorised by a randomised SVD
whose passes over the passages are Spark jobs. Windows of every document are
folded into the latent space and held against the passages by cosine. What is
near enough goes to the exact checks: the longest common subsequence of words,
and whether the passage's answer, its last words, is there as well; so a
paraphrase that keeps the wording's order is found, too.

The more passages there are, the less of each the latent space keeps, and the
lower is the cosine even of a verbatim copy. An index of every passage's rarest
words proposes copies as well, whatever the number of passages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlens.session import materialize

PUNCTUATION = b".,;:!?\"'()[]{}|"


@dataclass(frozen=True)
class Settings:
    """``block`` bounds the passages that are searched for, and broadcast, at once.

    Passages of fewer than ``least_words`` words count only as they are, all
    words in a row, and from ``least_exact`` words on.
    """

    rank: int = 128
    oversample: int = 8
    passage_words: int = 64
    windows: tuple[int, ...] = (16, 32, 64)
    cosine: float = 0.4
    copied: float = 0.75
    reworded: float = 0.5
    answer: float = 0.5
    least_words: int = 5
    least_exact: int = 3
    block: int = 10_000
    seed: int = 5


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION).split() if text else []


def passages(benchmark: DataFrame, settings: Settings) -> DataFrame:
    """(item_id, part, words): whole items, long ones in overlapping parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = settings.passage_words
        for batch in batches:
            ids, parts, words = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words_of(text)
                if item is None or len(found) < min(settings.least_words, settings.least_exact):
                    continue
                for part, start in enumerate(range(0, max(1, len(found) - size // 2), size // 2) if len(found) > size else [0]):
                    ids.append(item)
                    parts.append(part)
                    words.append(found[start : start + size])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(words, pa.list_(pa.binary()))], names=["item_id", "part", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, part int, words array<binary>")


def document_frequencies(docs: DataFrame, vocabulary: frozenset) -> tuple[int, dict[bytes, int]]:
    """Number of documents with words, and in how many of them each word of the vocabulary stands."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen, total = shared.value, Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                total += bool(words)
                seen.update(wanted.intersection(words))
        seen[b""] = total
        yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {bytes(r["word"]): r["n"] for r in counts.collect()}
    return found.pop(b"", 0), found


def randomised_svd(rows: DataFrame, features: int, settings: Settings) -> np.ndarray:
    """Right singular vectors (features x rank) of the sparse rows (places, weights).

    Three passes, each a job whose tasks emit only a product with a narrow
    matrix: two multiply by the Gram matrix, to find and to sharpen the range;
    the last one gives the small matrix whose eigenvectors order it.
    """
    spark = rows.sparkSession
    width = min(features, settings.rank + settings.oversample)

    def multiply(narrow: np.ndarray, small: bool) -> np.ndarray:
        shared = spark.sparkContext.broadcast(narrow)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            right = shared.value
            total = np.zeros((width if small else features, width))
            for batch in batches:
                for places, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    product = np.asarray(weights) @ right[places]
                    if small:
                        total += np.outer(product, product)
                    else:
                        total[places] += np.outer(weights, product)
            used = np.flatnonzero(total.any(axis=1))
            yield pa.record_batch([pa.array(used, pa.int64()), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["row", "v"])

        partial = rows.select("places", "weights").mapInArrow(run, "row long, v array<double>")
        summed = partial.groupBy("row").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(width)]).alias("v")).collect()
        result = np.zeros((width if small else features, width))
        for r in summed:
            result[r["row"]] = r["v"]
        return result

    basis = np.random.default_rng(settings.seed).standard_normal((features, width))
    for _ in range(2):
        basis = np.linalg.qr(multiply(basis, False))[0]
    values, turned = np.linalg.eigh(multiply(basis, True))
    order = np.argsort(-values)[: settings.rank]
    return basis @ turned[:, order]


@dataclass
class Index:
    """A block of passages with what a task needs to find them."""

    vocabulary: dict[bytes, int]
    idf: np.ndarray
    unknown: float
    vectors: np.ndarray
    items: np.ndarray
    words: list[list[bytes]]
    latent: np.ndarray


def build_index(block: DataFrame, total: int, frequencies: dict[bytes, int], settings: Settings) -> Index | None:
    """Fit the latent space on a block of passages; the rows of a block are bounded."""
    found = block.select("item_id", "part", "words").collect()
    found.sort(key=lambda r: (r["item_id"], r["part"], r["words"]))
    if not found:
        return None
    words = [[bytes(w) for w in r["words"]] for r in found]
    vocabulary = {w: i for i, w in enumerate(sorted({w for x in words for w in x}))}
    idf = np.array([np.log((total + 1) / (frequencies.get(w, 0) + 1)) + 0.1 for w in vocabulary])
    spark = block.sparkSession
    sparse = []
    for x in words:
        counts = Counter(vocabulary[w] for w in x)
        weights = np.array([n * idf[i] for i, n in counts.items()])
        sparse.append((list(counts), (weights / np.linalg.norm(weights)).tolist()))
    # The shortest take no part in the latent space.
    fitted = [row for row, x in zip(sparse, words, strict=True) if len(x) >= settings.least_words] or sparse
    rows = spark.createDataFrame(fitted, "places array<int>, weights array<double>").repartition(min(len(fitted), spark.sparkContext.defaultParallelism))
    vectors = randomised_svd(rows, len(vocabulary), settings)
    latent = np.stack([np.asarray(weights) @ vectors[places] for places, weights in sparse])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    # A word that no passage has counts as much in a window as the rarest that one has.
    return Index(vocabulary, idf, float(idf.max()), (vectors * idf[:, None]).astype(np.float32), np.array([r["item_id"] for r in found]), words, latent.astype(np.float32).T.copy())


def common_subsequence(masks: list[int], size: int, sequence: list[int]) -> int:
    """Length of the longest common subsequence, all places of the passage at once in one whole number.

    ``masks`` has, for every word of the passage, the bits of its places;
    ``sequence`` numbers the words of the text that occur in the passage.
    """
    full = (1 << size) - 1
    row = full
    for word in sequence:
        hit = row & masks[word]
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


class Searcher:
    """Finds the passages of an index in texts."""

    def __init__(self, index: Index, settings: Settings):
        self.index, self.settings = index, settings
        # One more row for words outside the vocabulary: nothing in the latent space, but of full length.
        self.vectors = np.vstack([index.vectors, np.zeros((1, index.vectors.shape[1]), np.float32)])
        self.square = np.append(index.idf, index.unknown) ** 2
        # Of every passage: its words by number, how often each stands in it, and the bits of its places.
        self.own, self.times, self.masks, self.answers = [], [], [], []
        for words in index.words:
            numbers = np.array([index.vocabulary[w] for w in words])
            own, local, times = np.unique(numbers, return_inverse=True, return_counts=True)
            masks = [0] * len(own)
            for i, number in enumerate(local.tolist()):
                masks[number] |= 1 << i
            self.own.append(own)
            self.times.append(times)
            self.masks.append(masks)
            # The answer: the rarer half of the last quarter of the words.
            last = sorted(set(words[-max(2, len(words) // 4) :]), key=lambda w: (-index.idf[index.vocabulary[w]], w))
            self.answers.append(np.searchsorted(own, [index.vocabulary[w] for w in last[: max(1, (len(last) + 1) // 2)]]))

        self._index_rare_words()

    def _index_rare_words(self) -> None:
        """Postings (passage, offset) of the rarest words of every passage, by word.

        A copy lacks at most ``1 - copied`` of the words. With ``needed`` words
        more than that, at least ``needed`` of those looked for are in it.
        """
        index, settings, size = self.index, self.settings, len(self.index.words)
        self.numbers = [np.array([index.vocabulary[w] for w in words]) for words in index.words]
        self.needed, self.reach = np.ones(size, np.int64), np.zeros(size, np.int64)
        words, passages, offsets = [], [], []
        for passage, numbers in enumerate(self.numbers):
            short = len(numbers) < settings.least_words
            missing = 0 if short else int((1 - settings.copied) * len(numbers))
            # Of one word there is one place only.
            self.needed[passage], self.reach[passage] = min(len(numbers), max(2, len(numbers) // 8)), 0 if short else len(numbers) // 2
            rarest = np.lexsort((numbers, -index.idf[numbers]))[: missing + self.needed[passage]]
            words.append(numbers[rarest])
            passages.append(np.full(len(rarest), passage))
            offsets.append(rarest)
        empty = [np.zeros(0, np.int64)]
        word = np.concatenate(words or empty)
        order = np.argsort(word, kind="stable")
        self.rare_passage, self.rare_offset = np.concatenate(passages or empty)[order], np.concatenate(offsets or empty)[order]
        # The last place is for words outside the vocabulary.
        self.rare_count = np.bincount(word, minlength=len(index.vocabulary) + 1)
        self.rare_first = np.cumsum(self.rare_count) - self.rare_count

    def places(self, words: list[bytes]) -> np.ndarray:
        vocabulary = self.index.vocabulary
        unknown = len(vocabulary)
        return np.fromiter([vocabulary.get(w, unknown) for w in words], np.int64, len(words))

    def candidates(self, places: np.ndarray) -> dict[int, list[tuple[int, int, float]]]:
        """Passage -> windows (start, stop, cosine) that are near it."""
        index, least, words = self.index, self.settings.cosine, places
        unknown = len(index.vocabulary)
        weight = np.append(0.0, np.cumsum(self.square[places]))
        inside = np.append(0.0, np.cumsum(np.where(places < unknown, self.square[places], 0.0)))
        # Only a window whose known part is long enough can come near; the others are ruled out exactly.
        starts, stops = [], []
        for size in self.settings.windows:
            first = np.arange(0, max(1, len(words) - size // 2), size // 2)
            last = np.minimum(first + size, len(words))
            fits = inside[last] - inside[first] >= least**2 * (weight[last] - weight[first])
            starts.append(first[fits])
            stops.append(last[fits])
        first, last = np.concatenate(starts), np.concatenate(stops)
        found: dict[int, list[tuple[int, int, float]]] = {}
        if not len(first):
            return found
        # Windows begin and, but for the text's end, stop at multiples of the step.
        step = min(self.settings.windows) // 2
        padded = np.append(places, np.full(-len(places) % step, unknown))
        sums = self.vectors[padded].reshape(-1, step, self.vectors.shape[1]).sum(axis=1)
        total = np.vstack([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)])
        latent = (total[-(-last // step)] - total[first // step]).astype(np.float32)
        latent /= np.sqrt(np.maximum(weight[last] - weight[first], 1e-9)).astype(np.float32)[:, None]
        for at in range(0, len(first), 4096):
            near = latent[at : at + 4096] @ index.latent
            for row, passage in zip(*np.nonzero(near >= least), strict=True):
                found.setdefault(int(passage), []).append((int(first[at + row]), int(last[at + row]), float(near[row, passage])))
        return found

    def runs(self, places: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Passage -> (first, last) of the places where it may begin by its rarest words.

        Every posting of a word of the text names a place where its passage
        would begin; where enough of them nearly agree, there may be a copy.
        """
        found: dict[int, list[tuple[int, int]]] = {}
        size, beyond = 8192, 2 * self.settings.passage_words
        for base in range(0, len(places), size):
            part = places[base : base + size + beyond]
            count = self.rare_count[part]
            total = int(count.sum())
            if not total:
                continue
            at = np.repeat(self.rare_first[part] - np.cumsum(count) + count, count) + np.arange(total)
            begin = np.repeat(np.arange(base, base + len(part)), count) - self.rare_offset[at] + beyond
            key = np.sort((self.rare_passage[at] << 40) + begin)
            passage = key >> 40
            last = np.searchsorted(key, key + self.reach[passage], "right")
            enough = np.flatnonzero(last - np.arange(total) >= self.needed[passage])
            # A run that ends where the one before does lies inside it.
            enough = enough[np.diff(last[enough], prepend=0) > 0]
            for i in enough.tolist():
                first, stop = (int(key[j] & ((1 << 40) - 1)) - beyond for j in (i, last[i] - 1))
                found.setdefault(int(passage[i]), []).append((first, stop))
        return found

    def cosine(self, window: np.ndarray, passage: int) -> float:
        """Cosine of the TF-IDF vectors of a window and a passage, outside the latent space."""
        unknown = len(self.index.vocabulary)
        words, times = np.unique(window[window < unknown], return_counts=True)
        length = (times**2 * self.square[words]).sum() + np.count_nonzero(window == unknown) * self.square[unknown]
        own, own_times = self.own[passage], self.times[passage]
        _, here, there = np.intersect1d(words, own, assume_unique=True, return_indices=True)
        product = (times[here] * own_times[there] * self.square[words[here]]).sum()
        return float(product / np.sqrt(max(length * (own_times**2 * self.square[own]).sum(), 1e-12)))

    def check_runs(self, places: np.ndarray, passage: int, runs: list[tuple[int, int]]) -> tuple[float, float, float] | None:
        """(subsequence share, answer share, cosine) of the best run that counts as a copy."""
        settings, best, size, seen = self.settings, None, len(self.numbers[passage]), set()
        if size < settings.least_words:
            whole = any(np.array_equal(places[max(0, first) : first + size], self.numbers[passage]) for first, _ in runs)
            return (1.0, 1.0, 1.0) if whole else None
        # Runs around which too few words are the passage's are ruled out together.
        own, begin = self.own[passage], np.array(runs)
        shared = np.append(0, np.cumsum(own[np.minimum(np.searchsorted(own, places), len(own) - 1)] == places))
        lo, hi = (np.clip(x, 0, len(places)) for x in (begin[:, 0] - size // 4, begin[:, 1] + size + size // 4))
        for i in np.flatnonzero(shared[hi] - shared[lo] >= settings.reworded * size).tolist():
            (first, last), region = runs[i], places[lo[i] : hi[i]]
            # Texts repeat lines.
            if (same := (first - last, region.tobytes())) in seen:
                continue
            seen.add(same)
            result = self.compare(region, passage)
            # So few words stand half in a row by chance.
            if result is None or (size < min(settings.windows) and result[0] < settings.copied):
                continue
            cosine = max(self.cosine(places[max(0, x) : max(0, x + size)], passage) for x in {first, last})
            if result[0] >= settings.copied or cosine >= settings.cosine:
                best = max(best, (*result, cosine)) if best else (*result, cosine)
                if best[0] == 1:
                    break
        return best

    def compare(self, region: np.ndarray, passage: int) -> tuple[float, float] | None:
        """(subsequence share, answer share) if the region holds a copy of the passage."""
        settings, wanted, own = self.settings, self.index.words[passage], self.own[passage]
        local = np.searchsorted(own, region)
        local[local == len(own)] = 0
        local = local[own[local] == region]
        # No subsequence is longer than the words in common, each as often as in both.
        counts = np.bincount(local, minlength=len(own))
        if np.minimum(counts, self.times[passage]).sum() < settings.reworded * len(wanted):
            return None
        share = common_subsequence(self.masks[passage], len(wanted), local.tolist()) / len(wanted)
        answer = float(np.count_nonzero(counts[self.answers[passage]]) / len(self.answers[passage]))
        return (share, answer) if share >= settings.copied or (share >= settings.reworded and answer >= settings.answer) else None

    def check(self, places: np.ndarray, passage: int, windows: list[tuple[int, int, float]]) -> tuple[float, float, float] | None:
        """(subsequence share, answer share, cosine) of the best window that counts as a copy."""
        best, size = None, len(self.index.words[passage])
        if size < self.settings.least_words:
            return None
        for start, stop, cosine in windows:
            # The passage may begin before the window and end behind it.
            lo, hi = max(0, min(start, stop - size) - 4), min(len(places), max(stop, start + size) + 4)
            result = self.compare(places[lo:hi], passage)
            if result:
                best = max(best, (*result, cosine)) if best else (*result, cosine)
        return best

    def search(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """Item -> best (subsequence share, answer share, cosine)."""
        words = words_of(text)
        found: dict[int, tuple[float, float, float]] = {}
        if not words:
            return found
        places = self.places(words)
        results = {passage: self.check(places, passage, windows) for passage, windows in self.candidates(places).items()}
        for passage, runs in self.runs(places).items():
            if not results.get(passage):
                results[passage] = self.check_runs(places, passage, runs)
        for passage, result in results.items():
            item = int(self.index.items[passage])
            if result and (item not in found or result > found[item]):
                found[item] = result
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, lcs_share, answer_share, cosine.

    Document frequencies are counted over all documents, every window of every
    whole text is searched. The cosine is that of the latent space or, where the
    latent space misses a copy, that of the TF-IDF vectors. Null and empty texts
    hold nothing. Items without id or with fewer than ``least_exact`` words are
    not searched for, those with fewer than ``least_words`` only as they are.
    Repeated rows are found each. A benchmark of more than ``block`` passages is
    searched for block by block. Other columns are not looked at.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, lcs_share double, answer_share double, cosine double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = spark.createDataFrame([], schema)
    for index in indexes(texts, benchmark, settings):
        result = result.unionByName(texts.mapInArrow(_search_with(spark.sparkContext.broadcast(index), settings), schema))
    return result


def indexes(texts: DataFrame, benchmark: DataFrame, settings: Settings) -> Iterator[Index]:
    """An index for each block of the benchmark's passages, weighted by the counts in ``texts``."""
    parts = materialize(passages(benchmark, settings), "passages")
    blocks = -(-parts.count() // settings.block)
    for number in range(blocks):
        block = parts.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == number)
        words = frozenset(bytes(r["word"]) for r in block.select(F.explode("words").alias("word")).distinct().collect())
        total, frequencies = document_frequencies(texts, words)
        index = build_index(block, total, frequencies, settings)
        if index is not None:
            yield index


def _search_with(shared, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value, settings)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = [(doc, item, *found) for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for item, found in searcher.search(text).items()]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "lcs_share", "answer_share", "cosine"])

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns.

    Rows are judged each by its own text, so null and repeated ids do not matter.
    """
    kept = docs
    for index in indexes(docs, benchmark, settings):
        kept = kept.mapInArrow(_keep_with(docs.sparkSession.sparkContext.broadcast(index), docs.columns.index("text"), settings), docs.schema)
    return kept


def _keep_with(shared, column: int, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value, settings)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield part.filter(pa.array([not searcher.search(x) for x in part.column(column).to_pylist()], pa.bool_()))

    return run
