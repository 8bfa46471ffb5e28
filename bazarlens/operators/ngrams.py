"""N-gram frequencies of a corpus, in one pass over it.

A task counts the n-grams of about two million tokens at a time, on numbers that
stand for its words, and sends every n-gram once, with its counts: packed by a
slot that follows from its words alone. What meets in a slot is added up there.
So the work and what is shuffled grow with the corpus, and nothing is sent to
all tasks or to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazarlens.functions.text import ngrams

MIN_DF = 3
MAX_FEATURES = 5000
# Slots that n-grams are dealt to; a task adds up one at a time.
SLOTS = 1 << 12
# Tokens that a task counts at a time.
CHUNK_TOKENS = 1 << 21


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order of the keys, where in it a run of equal ones starts)."""
    low = np.uint64(max(1, len(keys) - 1).bit_length())
    if len(keys) and int(keys.max()).bit_length() + int(low) <= 64:
        # Sorting whole numbers is much faster than sorting places by them.
        order = (np.sort(keys << low | np.arange(len(keys), dtype=np.uint64)) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    else:
        order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(keys)])


class _Levels:
    """The n-grams of many arrays of word numbers at once, size after size; equal n-grams have equal keys."""

    def __init__(self, words: pa.ListArray, slots: int):
        self.slots = slots
        self.words = words.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
        lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.starts = np.cumsum(lengths) - lengths
        self.at, self.key, self.n = np.arange(len(self.words)), self.words, 1

    def slot(self) -> np.ndarray:
        return (self.key ^ self.key >> np.uint64(29)) & np.uint64(self.slots - 1)

    def keep(self, bits: np.ndarray) -> None:
        """Drop the n-grams whose slot is not marked."""
        slot = self.slot()
        kept = bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) == 1
        self.at, self.key = self.at[kept], self.key[kept]

    def rank(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of each n-gram among the different ones, index of the first of each)."""
        order, first = _runs(self.key)
        ranks = np.empty(len(order), np.uint64)
        ranks[order] = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, len(order))))
        return ranks, order[first]

    def widen(self, ranks: np.ndarray | None = None) -> None:
        """From n-grams to (n+1)-grams: those whose first and last n tokens are both there."""
        ranks = self.rank()[0] if ranks is None else ranks
        both = np.append(np.diff(self.at) == 1, False)[: len(self.at)]
        both[:-1] &= self.doc[self.at[:-1]] == self.doc[self.at[1:]]
        self.at, ranks = self.at[both], ranks[both]
        # The last token of an (n+1)-gram must belong to the same text.
        inside = self.at + self.n < len(self.words)
        inside[inside] = self.doc[self.at[inside]] == self.doc[self.at[inside] + self.n]
        self.at, ranks = self.at[inside], ranks[inside]
        # Ranks and words are numbers of things in one chunk, so their product fits.
        self.key = ranks * (self.words.max(initial=0) + np.uint64(1)) + self.words[self.at + self.n]
        self.n += 1

    def places(self) -> pa.ListArray:
        """Per text the starts of its n-grams, from 1."""
        ends = np.searchsorted(self.doc[self.at], np.arange(len(self.starts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array((self.at - self.starts[self.doc[self.at]] + 1).astype(np.int32)))


def _chunks(tokens: pa.ListArray) -> Iterator[pa.ListArray]:
    """The texts in runs of about :data:`CHUNK_TOKENS` tokens; a longer text is a run of its own."""
    ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < len(tokens):
        stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_TOKENS, side="right")))
        yield tokens.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def _counted(tokens: pa.ListArray, sizes: tuple[int, ...], slots: int) -> Iterator[pa.RecordBatch]:
    """Per size one row a slot: the different n-grams of the texts, how often they occur and in how many texts."""
    encoded = tokens.flatten().dictionary_encode(null_encoding="encode")
    words = encoded.dictionary
    ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    levels = _Levels(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), encoded.indices), slots)
    listed = words.to_pylist()
    # The sum over what blanks divide, so a term has one slot however it was cut into tokens.
    hashes = np.array([sum(zlib.crc32(p.encode()) for p in w.split(" ")) if w else 0 for w in listed], np.uint64)
    # A null is left out together with its blank.
    glued = pc.binary_join_element_wise(" ", words, "").fill_null("") if words.null_count else words
    # Only then can different tokens make the same term.
    alike = any(w is None or " " in w for w in listed)
    for n in range(1, max(sizes) + 1):
        ranks, firsts = levels.rank()
        if n in sizes and len(firsts):
            parts = [levels.words[levels.at[firsts] + i].astype(np.int64) for i in range(n)]
            terms = pc.binary_join_element_wise(*[glued.take(pa.array(p)) for p in parts], "" if words.null_count else " ")
            if words.null_count:
                terms = pc.utf8_slice_codeunits(terms, 1)
            same = ranks
            if alike:
                found = terms.dictionary_encode()
                codes = found.indices.to_numpy()
                same, terms = codes[ranks.astype(np.int64)].astype(np.uint64), found.dictionary
                parts = [p[np.unique(codes, return_index=True)[1]] for p in parts]
            order, first = _runs(same)
            doc = levels.doc[levels.at[order]]
            new = np.append(True, doc[1:] != doc[:-1])
            new[first] = True
            freq, docs = np.diff(np.append(first, len(order))), np.add.reduceat(new, first, dtype=np.int64)
            mixed = (sum(hashes[p] for p in parts) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            slot = (mixed & np.uint64(slots - 1)).astype(np.int64)
            dealt, at = _runs(slot.astype(np.uint64))
            offsets = pa.array(np.append(at, len(slot)).astype(np.int32))
            packed = [pa.ListArray.from_arrays(offsets, x.take(pa.array(dealt))) for x in (terms, pa.array(freq), pa.array(docs))]
            yield pa.record_batch([pa.array(np.full(len(at), n)), pa.array(slot[dealt[at]]), *packed], names=["n", "slot", "terms", "freq", "docs"])
        if n < max(sizes):
            levels.widen(ranks)


def ngram_counts(
    tokenized: DataFrame, tokens: str = "tokens", sizes: tuple[int, ...] = (1, 2, 3), min_df: int = MIN_DF, slots: int = SLOTS
) -> DataFrame:
    """(n, term, freq, doc_freq) of terms in at least ``min_df`` documents.

    One pass and one shuffle. A term crosses the shuffle once per chunk of
    texts that it occurs in; arrays of terms do, not rows. ``slots``, a power of
    two, is the number of groups that they are dealt to, so a task adds up that
    part of all different terms at a time.
    """
    if max(sizes) == 1 or min_df <= 1:
        return _plain_counts(tokenized, tokens, sizes, min_df)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch.column(0)):
                yield from _counted(chunk, sizes, slots)

    def add_up(group: pa.Table) -> pa.Table:
        per_row = pc.list_value_length(group["terms"]).to_numpy()
        flat = pa.table({"n": np.repeat(group["n"].to_numpy(), per_row), **{c: pc.list_flatten(group[c]) for c in ("terms", "freq", "docs")}})
        summed = flat.group_by(["n", "terms"]).aggregate([("freq", "sum"), ("docs", "sum")])
        kept = summed.filter(pc.greater_equal(summed["docs_sum"], min_df))
        return pa.table([kept[c] for c in ("n", "terms", "freq_sum", "docs_sum")], names=["n", "term", "freq", "doc_freq"])

    packed = tokenized.select(tokens).mapInArrow(count, "n long, slot long, terms array<string>, freq array<long>, docs array<long>")
    return packed.groupBy("slot").applyInArrow(add_up, "n long, term string, freq long, doc_freq long")


def _plain_counts(tokenized: DataFrame, tokens: str, sizes: tuple[int, ...], min_df: int) -> DataFrame:
    """The same by exploded rows: words repeat so much that partial sums leave few of them.

    The terms of a document are sorted inside its row, so the first of equal
    terms is known without a shuffle by document.
    """
    sets = []
    for n in sizes:
        ordered = F.sort_array(ngrams(F.col(tokens), n))
        before = F.slice(F.concat(F.array(F.lit(None).cast("string")), ordered), 1, F.size(ordered))
        flagged = F.zip_with(ordered, before, lambda a, b: F.struct(a.alias("term"), (~a.eqNullSafe(b)).cast("long").alias("first")))
        sets.append(F.struct(F.lit(n).cast("long").alias("n"), flagged.alias("terms")))
    counted = tokenized.select(F.inline(F.array(*sets))).select("n", F.inline("terms"))
    return (
        counted.groupBy("n", "term")
        .agg(F.count(F.lit(1)).alias("freq"), F.sum("first").alias("doc_freq"))
        .filter(F.col("doc_freq") >= min_df)
    )


def vocab_limit(counts: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), max_features: int = MAX_FEATURES) -> DataFrame:
    """The most frequent terms of each size; a top-k per size, no global sort."""
    parts = [
        counts.filter(F.col("n") == n).orderBy(F.desc("freq"), F.asc("term")).limit(max_features) for n in sizes
    ]
    return reduce(DataFrame.unionByName, parts)


def top_ngrams(counts: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent terms of each size, ties by term."""
    order = Window.partitionBy("n").orderBy(F.desc("freq"), F.asc("term"))
    return counts.withColumn("posicion", F.row_number().over(order).cast("long")).filter(F.col("posicion") <= k)


def corpus_term_weights(counts: DataFrame, k: int = 150) -> DataFrame:
    """The k most frequent words with their weight relative to the first."""
    words = counts.filter(F.col("n") == 1).orderBy(F.desc("freq"), F.asc("term")).limit(k)
    return words.select("term", "freq", (F.col("freq") / F.max("freq").over(Window.partitionBy())).alias("weight"))
