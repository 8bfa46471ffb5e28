"""Ranked lexical search with pair-bound MaxScore over a written index.

The index holds, per block of documents, the postings of every term. For the
pairs of the corpus's most frequent terms, each block also keeps the
intersection of their lists, as a bitmap, with the largest impact that one
document reaches on both. MaxScore leaves out documents that hold only terms
whose bounds together stay under the k-th best score. Frequent terms seldom
reach their maxima in the same document, so a bound that joins them by pairs is
lower than the sum of their own maxima: more lists need not be opened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazarlens.session import materialize

_NO_TERM = bytes(c for c in range(128) if not chr(c).isalnum())
SEPARATORS = bytes.maketrans(_NO_TERM, b" " * len(_NO_TERM))


@dataclass(frozen=True)
class Search:
    """Parameters: results per item, documents and postings of an index block, frequent terms that are paired, items searched together."""

    k: int = 50
    block_docs: int = 8192
    block_words: int = 4_000_000
    paired_terms: int = 64
    items_per_batch: int = 1000


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().translate(SEPARATORS).split() if text else []


# --- index -------------------------------------------------------------------

INDEX_SCHEMA = "block long, term binary, docs array<int>, counts array<int>, size int, ids array<long>"


def write_blocks(docs: DataFrame, settings: Search = Search()) -> DataFrame:
    """The written postings of every document that has a term.

    A row per block and term: positions of its documents in the block and the
    term's occurrences in them. The row whose term is null has the documents
    themselves: ``ids``, and their lengths in ``counts``. A block ends with
    the document that fills it; its number is the task's and a running one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, serial = TaskContext.get().partitionId() << 32, {}
        ids, lengths, tokens, total = [], [], [], 0

        def finish() -> pa.RecordBatch:
            words = list(serial)
            place = np.repeat(np.arange(len(ids), dtype=np.int64), lengths)
            key, counts = np.unique(np.concatenate(tokens).astype(np.int64) * len(ids) + place, return_counts=True)
            term, doc = np.divmod(key, len(ids))
            ends = np.concatenate([np.searchsorted(term, np.arange(len(words))), [len(key), len(key) + len(ids)]]).astype(np.int32)
            lists = lambda flat: pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
            every = np.concatenate([doc, np.arange(len(ids))]), np.concatenate([counts, np.array(lengths)])
            own = pa.array([None] * len(words) + [ids], pa.list_(pa.int64()))
            return pa.record_batch(
                [pa.array([number] * (len(words) + 1), pa.int64()), pa.array([*words, None], pa.binary()), lists(every[0]), lists(every[1]), pa.array(np.diff(ends)), own],
                names=["block", "term", "docs", "counts", "size", "ids"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                ids.append(doc_id)
                lengths.append(len(words))
                tokens.append(np.fromiter((serial.setdefault(w, len(serial)) for w in words), np.int32, len(words)))
                total += len(words)
                if len(ids) >= settings.block_docs or total >= settings.block_words:
                    yield finish()
                    number, serial = number + 1, {}
                    ids, lengths, tokens, total = [], [], [], 0
        if ids:
            yield finish()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(texts.mapInArrow(run, INDEX_SCHEMA), "lexical-index")


@dataclass(frozen=True)
class Index:
    """Written postings and term counts, the corpus's size, the frequent terms and the tables of their pairs."""

    blocks: DataFrame
    terms: DataFrame
    pairs: DataFrame
    documents: int
    length: int
    frequent: tuple[bytes, ...]


def impact_function(documents: int, length: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Impacts, not yet weighed, of counts in documents of some lengths."""

    def impacts(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        m = 50 + 50 * lengths * documents // length
        return 1_000_000_000 * counts // (1000 * counts + 20 * m)

    return impacts


def weights(index: Index) -> DataFrame:
    """(term, w) of every term of the corpus."""
    rarity = F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1))
    return index.terms.select("term", F.floor(1000 * rarity).cast("long").alias("w"))


PAIR_SCHEMA = "block long, a binary, b binary, joint long, bits binary"


def _flat(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as integer arrays."""
    joined = column.combine_chunks()
    joined = pa.concat_arrays(joined.chunks) if isinstance(joined, pa.ChunkedArray) else joined
    return [x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in joined]


def build_index(docs: DataFrame, settings: Search = Search()) -> Index:
    """Postings, document frequencies and, per block, the pair lists of the most frequent terms.

    The frequent terms are ``paired_terms`` in number, whatever the corpus; a
    pair takes one bit per document of the block and one number. The largest
    joint impact holds the weights of both terms.
    """
    blocks = write_blocks(docs, settings)
    spark = blocks.sparkSession
    length = F.aggregate("counts", F.lit(0).cast("long"), lambda total, n: total + n)
    sums = blocks.where("term IS NULL").agg(F.sum("size"), F.sum(length)).first()
    terms = blocks.where("term IS NOT NULL").groupBy("term").agg(F.sum("size").alias("df"))
    terms = materialize(terms, "terms")
    index = Index(blocks, terms, spark.createDataFrame([], PAIR_SCHEMA), int(sums[0] or 0), int(sums[1] or 0), ())
    top = weights(index).join(terms, "term").orderBy(F.desc("df"), "term").limit(settings.paired_terms).collect()
    if len(top) < 2:
        return index
    weight = {bytes(r["term"]): r["w"] for r in top}
    impacts_of = impact_function(index.documents, index.length)

    def pair_up(table: pa.Table) -> pa.Table:
        names, docs_of, counts_of = table["term"].to_pylist(), _flat(table["docs"]), _flat(table["counts"])
        lengths = counts_of[names.index(None)]
        used = sorted((i for i, name in enumerate(names) if name is not None), key=names.__getitem__)
        impact, present = np.zeros((len(used), len(lengths)), np.int64), np.zeros((len(used), len(lengths)), bool)
        for row, i in enumerate(used):
            impact[row, docs_of[i]] = weight[names[i]] * impacts_of(counts_of[i], lengths[docs_of[i]])
            present[row, docs_of[i]] = True
        found = []
        for row, i in enumerate(used):
            both = present[row + 1 :] & present[row]
            joint = np.where(both, impact[row + 1 :] + impact[row], 0).max(axis=1, initial=0)
            packed = np.packbits(both, axis=1, bitorder="little")
            found += [(names[i], names[j], int(joint[x]), packed[x].tobytes()) for x, j in enumerate(used[row + 1 :]) if both[x].any()]
        first, second, joint, bits = zip(*found, strict=True) if found else ((), (), (), ())
        block = table["block"][0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * len(found), pa.int64()),
                "a": pa.array(first, pa.binary()),
                "b": pa.array(second, pa.binary()),
                "joint": pa.array(joint, pa.int64()),
                "bits": pa.array(bits, pa.binary()),
            }
        )

    wanted = blocks.where(F.col("term").isNull() | F.col("term").isin([F.lit(bytearray(t)) for t in weight]))
    pairs = wanted.select("block", "term", "docs", "counts").groupBy("block").applyInArrow(pair_up, PAIR_SCHEMA)
    return Index(blocks, terms, materialize(pairs, "term-pairs"), index.documents, index.length, tuple(weight))


# --- search ------------------------------------------------------------------


class BlockSearch:
    """Finds the best documents of one block.

    ``lists`` has (documents, weighted impacts) per term, ``pairs`` has
    (joint maximum, bitmap) per pair of frequent terms that meet in the block.
    ``opened`` counts the postings that were added up, ``looked_up`` the
    single documents that were looked for in a list.
    """

    def __init__(self, n_docs: int, lists: dict, pairs: dict, frequent: set, ids: np.ndarray, k: int):
        self.n_docs, self.lists, self.pairs, self.frequent, self.ids, self.k = n_docs, lists, pairs, frequent, ids, k
        self.most = {t: int(x[1].max()) for t, x in lists.items()}
        self.opened = self.looked_up = 0

    def matchings(self, terms: list) -> list[tuple[int, list[tuple], list]]:
        """For every number i: (bound, pairs, single terms) of the first i terms.

        Pairs are formed greedily, those first whose bound saves most against
        the sum of two maxima. Never more than that sum, so no list is opened
        that independent maxima would leave closed.
        """
        gains = []
        for j, b in enumerate(terms):
            for i in range(j if b in self.frequent else 0):
                if (a := terms[i]) in self.frequent:
                    pair = (a, b) if a < b else (b, a)
                    joint = self.pairs[pair][0] if pair in self.pairs else 0
                    gain = self.most[a] + self.most[b] - max(joint, self.most[a], self.most[b])
                    if gain > 0:
                        gains.append((gain, j, i, pair))
        gains.sort(key=lambda g: -g[0])
        total, found = 0, [(0, [], [])]
        for end, term in enumerate(terms, 1):
            total += self.most[term]
            free, bound, pairs = set(range(end)), total, []
            for gain, j, i, pair in gains if term in self.frequent else ():
                if j < end and i in free and j in free:
                    free -= {i, j}
                    bound -= gain
                    pairs.append(pair)
            if term not in self.frequent:
                # No new pair: the last matching with one more single term.
                last = found[-1]
                found.append((last[0] + self.most[term], last[1], [*last[2], term]))
            else:
                found.append((bound, pairs, [terms[i] for i in sorted(free)]))
        return found

    def rest(self, pairs: list[tuple], singles: list, docs: np.ndarray) -> np.ndarray:
        """What the terms can still add to each document: a joint maximum only within the pair's intersection."""
        total = np.full(len(docs), sum(self.most[t] for t in singles), np.int64)
        for pair in pairs:
            single = max(self.most[t] for t in pair)
            joint, bits = self.pairs.get(pair, (0, None))
            total += single if joint <= single else np.where(bits[docs >> 3] >> (docs & 7) & 1, joint, single)
        return total

    def best(self, terms: list) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best, equal scores by id."""
        terms = sorted((t for t in terms if t in self.lists), key=lambda t: (self.most[t], t))
        left = self.matchings(terms)
        scores, candidates, floor = np.zeros(self.n_docs, np.int64), None, 1
        for at in range(len(terms) - 1, -1, -1):
            docs, impacts = self.lists[terms[at]]
            if candidates is None:
                scores[docs] += impacts
                self.opened += len(docs)
            else:
                place = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
                scores[candidates] += np.where(docs[place] == candidates, impacts[place], 0)
                self.looked_up += len(candidates)
            seen = scores if candidates is None else scores[candidates]
            if len(seen) > self.k:
                floor = max(floor, int(np.partition(seen, len(seen) - self.k)[len(seen) - self.k]))
            bound, pairs, singles = left[at]
            if candidates is None and bound < floor:
                # Who has nothing yet cannot get among the best any more.
                candidates = np.flatnonzero(scores + bound >= floor)
            if candidates is not None and at:
                candidates = candidates[scores[candidates] + self.rest(pairs, singles, candidates) >= floor]
        found = np.flatnonzero(scores) if candidates is None else candidates
        found = found[scores[found] >= floor]
        found = found[np.lexsort((self.ids[found], -scores[found]))[: self.k]]
        return found, scores[found]


RESULT_SCHEMA = "item_id long, block long, place int, doc_id long, score long"


def search(index: Index, items: DataFrame, settings: Search = Search()) -> DataFrame:
    """The k best documents of every item: item_id, rank (from 1), doc_id, score.

    Equal scores go by ascending doc_id, a row without doc_id last. Rows that
    repeat a doc_id are documents of their own. A null or blank text has no
    terms: as a document it does not count, as an item it finds nothing. Rows
    that repeat an item_id are one item with the terms of all; rows without
    item_id are not searched. Columns besides ids and texts are not looked at.

    Terms meet postings in an ordinary join; a block's postings and the items
    of a batch are one group of bounded size, and only its k best documents
    per item go on to the last ranking.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in set(terms_of(text))]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["item_id", "term"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL")
    asked = materialize(texts.mapInArrow(split, "item_id long, term binary").distinct(), "item-terms")
    batches = max(1, -(-asked.select("item_id").distinct().count() // settings.items_per_batch))
    batch = F.pmod(F.xxhash64("item_id"), F.lit(batches)).cast("int").alias("batch")
    asked = asked.groupBy(batch, "term").agg(F.collect_list("item_id").alias("items")).join(weights(index), "term")
    postings = index.blocks.where("term IS NOT NULL").join(asked, "term")
    none = lambda kind: F.lit(None).cast(kind)
    every = F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch")
    postings = postings.select("block", "batch", "term", none("binary").alias("b"), "w", "docs", "counts", F.col("items").alias("ids"), none("binary").alias("bits"))
    own = index.blocks.where("term IS NULL").select("block", every, "term", none("binary").alias("b"), none("long").alias("w"), "docs", "counts", "ids", none("binary").alias("bits"))
    pairs = index.pairs.select(
        "block", every, F.col("a").alias("term"), "b", F.col("joint").alias("w"), none("array<int>").alias("docs"), none("array<int>").alias("counts"), none("array<long>").alias("ids"), "bits"
    )
    frequent, impacts_of = set(index.frequent), impact_function(index.documents, index.length)

    def find(table: pa.Table) -> pa.Table:
        terms, seconds, weight, bits = (table[c].to_pylist() for c in ("term", "b", "w", "bits"))
        own_row = terms.index(None)
        is_list = np.array([b is None and t is not None for t, b in zip(terms, seconds, strict=True)])
        head = table.slice(own_row, 1)
        lengths = _flat(head["counts"])[0]
        ids = head["ids"][0].values
        keys = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(is_list)
        part = table.take(pa.array(at))
        lists, asking = {}, {}
        for i, docs, counts, wanted in zip(at.tolist(), _flat(part["docs"]), _flat(part["counts"]), part["ids"].to_pylist(), strict=True):
            lists[terms[i]] = docs, weight[i] * impacts_of(counts, lengths[docs])
            for item in wanted:
                asking.setdefault(item, []).append(terms[i])
        pairs_ = {(terms[i], seconds[i]): (weight[i], np.frombuffer(bits[i], np.uint8)) for i in range(len(terms)) if seconds[i] is not None}
        block = BlockSearch(len(lengths), lists, pairs_, frequent, keys, settings.k)
        columns: list[list] = [[], [], []]
        for item, words in asking.items():
            docs, scores = block.best(words)
            columns[0] += [item] * len(docs)
            columns[1].append(docs)
            columns[2].append(scores)
        places = np.concatenate([*columns[1], np.zeros(0, np.int64)])
        return pa.table(
            {
                "item_id": pa.array(columns[0], pa.int64()),
                "block": pa.array([table["block"][0].as_py()] * len(places), pa.int64()),
                "place": pa.array(places.astype(np.int32)),
                "doc_id": ids.take(pa.array(places)),
                "score": pa.array(np.concatenate([*columns[2], np.zeros(0, np.int64)]).astype(np.int64)),
            }
        )

    groups = postings.unionByName(own).unionByName(pairs).groupBy("block", "batch")
    found = groups.applyInArrow(find, RESULT_SCHEMA)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.k)
    return ranked.select("item_id", "rank", "doc_id", "score")
