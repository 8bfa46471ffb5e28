"""N-gram Jaccard self-join by parity sketches.

Every shingle flips one bit of a document's sketch, so shingles that two
documents share cancel out and the Hamming distance of their sketches is at
most their symmetric difference. A similarity bounds that difference by the
set sizes. Sketches of one size band are cut into more words than shingles
may differ; then at least one word, and the XOR of the shingles that fell into
it, is the same in both (pigeonhole). Documents meet on such words, the
Hamming bound sifts them, full sets verify. Nothing is left to chance: no
pair at or above the threshold is lost.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlens.llm.common import WordHashes, ascii_words, mix64
from bazarlens.llm.components import connected_components
from bazarlens.session import materialize

# A centre's members are dealt out over this many tasks at most.
SALTS = 256
OUTSIDERS_PER_GROUP = 500
MEMBERS_PER_GROUP = 4000
LARGEST_SET = 1 << 40


@dataclass(frozen=True)
class ParityJoin:
    """Parameters: shingle width, least similarity in percent, growth of the size bands in percent."""

    shingle_words: int = 4
    percent: int = 85
    band_growth: int = 130
    bits_per_shingle: int = 1

    @cached_property
    def starts(self) -> list[int]:
        """Least set size of every band."""
        starts = [1]
        while starts[-1] < LARGEST_SET:
            starts.append(max(starts[-1] + 1, starts[-1] * self.band_growth // 100))
        return starts

    def band(self, size: int) -> int:
        return bisect_right(self.starts, size) - 1

    def difference(self, total: int) -> int:
        """Largest symmetric difference of two similar sets whose sizes add up to ``total``."""
        return total * (100 - self.percent) // (100 + self.percent)

    def bands(self, size: int) -> range:
        """Bands of the larger set in the pairs that a set of this size may be in."""
        return range(self.band(size), self.band(size * 100 // self.percent) + 1)

    def words(self, band: int) -> tuple[int, int]:
        """(words of the sketch, words with the fewest shingles that are left out).

        d + 1 words would do for a difference of d. With ``spare`` words more,
        two sketches share spare + 1, the fullest of which is among the
        fullest d + 1 of either: poor words need not be joined on.
        """
        differing = self.difference(2 * (self.starts[band + 1] - 1))
        spare = 1 + differing // 6 if differing else 0
        return differing + 1 + spare, spare

    def sketch_words(self, size: int) -> int:
        """64-bit words of the sketch that sifts; a power of two, so that it folds to a smaller one."""
        return max(1, 1 << (size * self.bits_per_shingle - 1).bit_length() >> 6) if size else 0


class ParitySketcher:
    """Shingle sets, joining keys and foldable sketches of texts."""

    def __init__(self, settings: ParityJoin):
        self.settings = settings
        self.hashes = WordHashes()

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the distinct shingles; fewer words than the width are one shingle."""
        words = self.hashes.of(ascii_words(text))
        width = min(self.settings.shingle_words, len(words))
        if not width:
            return words
        count = len(words) - width + 1
        rolled = np.full(count, 0x51ED270B9F652295 + width, np.uint64)
        for i in range(width):
            rolled = mix64((rolled ^ words[i : i + count]) * np.uint64(0xC2B2AE3D27D4EB4F))
        return np.unique(rolled)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """What a document is joined on: the fuller words of its sketch in every band it may meet another in."""
        found = []
        for band in self.settings.bands(len(shingles)):
            words, spare = self.settings.words(band)
            if words == 1:
                # Nothing may differ: equal sets have met before.
                continue
            salted = mix64(shingles + np.uint64((band + 1) << 40))
            at = ((salted >> np.uint64(32)) % np.uint64(words)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            counts = np.bincount(at, minlength=words)
            used = np.flatnonzero(counts)
            first = (np.cumsum(counts) - counts)[used]
            parity, folded = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
            parity[used] = np.bitwise_xor.reduceat((np.uint64(1) << (salted & np.uint64(63)))[order], first)
            folded[used] = np.bitwise_xor.reduceat(shingles[order], first)
            full = np.argsort(counts, kind="stable")[spare:]
            place = mix64(np.uint64((band + 1) << 32) + full.astype(np.uint64))
            found.append(mix64(mix64(parity[full] ^ place) + folded[full]))
        return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)

    def sketch(self, shingles: np.ndarray, words: int | None = None) -> np.ndarray:
        """The bits that an odd number of shingles flips; by folding, a longer sketch becomes that of fewer words."""
        bits = 64 * (words or self.settings.sketch_words(len(shingles)))
        flips = np.bincount((mix64(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


ROW_SCHEMA = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, keys array<long>, sketch array<long>"


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def parity_rows(docs: DataFrame, settings: ParityJoin) -> DataFrame:
    """One row per document: size and 128-bit identity of its set, joining keys, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = ParitySketcher(settings)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sizes, first, second, keys, bits = [], [], [], [], []
                for text in part.column(2).to_pylist():
                    found = sketcher.shingles(text)
                    sizes.append(len(found))
                    place = np.arange(1, len(found) + 1, dtype=np.uint64)
                    first.append(int(mix64(found * np.uint64(0xA24BAED4963EE407) + place).sum().view(np.int64)))
                    second.append(int(mix64(found ^ mix64(place)).sum().view(np.int64)))
                    keys.append(sketcher.keys(found) if len(found) else None)
                    bits.append(sketcher.sketch(found).view(np.int64) if len(found) else None)
                arrays = [part.column(0), part.column(1)] + [pa.array(x, pa.int64()) for x in (sizes, first, second)]
                arrays += [pa.array(x, pa.list_(pa.int64())) for x in (keys, bits)]
                yield pa.record_batch(arrays, names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "keys", "sketch"])

    return _texts(docs).mapInArrow(run, ROW_SCHEMA)


def hamming(left: Column, right: Column) -> Column:
    """Differing bits of two sketches; the longer one is folded to the length of the other."""

    def fold(x: Column, words: Column) -> Column:
        halves = F.zip_with(F.slice(x, 1, words), F.slice(x, words + 1, words), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(x) > words, halves).otherwise(x)

    words = F.least(F.size(left), F.size(right))
    bits = F.zip_with(fold(left, words), fold(right, words), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(bits, F.lit(0), lambda total, x: total + x)


def _sifted(pairs: DataFrame, classes: DataFrame, settings: ParityJoin) -> DataFrame:
    """Pairs whose sizes and sketches allow the similarity."""
    side = lambda name: classes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_s"))
    joined = pairs.join(side("member"), "member").join(side("centre"), "centre")
    sizes = F.least("member_n", "centre_n") * 100 >= settings.percent * F.greatest("member_n", "centre_n")
    most = (F.col("member_n") + F.col("centre_n")) * (100 - settings.percent)
    # The folding of sketches needs lengths that differ by one doubling at most; the size test comes first.
    near = F.when(sizes, hamming(F.col("member_s"), F.col("centre_s")) * (100 + settings.percent) <= most)
    return joined.where(F.coalesce(near, F.lit(False))).select("member", "centre")


def _class_texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the wanted classes, one row each."""
    wanted = classes.join(nodes, "node").select("node", "first.doc_id", "first.text_key")
    texts = _texts(docs)
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_key"] == wanted["text_key"])
    return texts.join(wanted, same).select("node", "text").dropDuplicates(["node"])


def _verify_centres(pairs: DataFrame, classes: DataFrame, docs: DataFrame, settings: ParityJoin) -> DataFrame:
    """The pairs (member, centre) that are similar, as links (u, v).

    Members are salted, and the centre's text goes to each salt that has
    members: no more texts than twice the pairs, and no task that a large
    group must pass through.
    """
    salt = F.pmod(F.xxhash64("member"), F.lit(SALTS))
    members = pairs.select("centre", salt.alias("salt"), "member", F.lit(1).alias("role"))
    wanted = members.unionByName(members.select("centre", "salt", F.col("centre").alias("member"), F.lit(0).alias("role")).distinct())
    texts = _class_texts(wanted.select(F.col("member").alias("node")).distinct(), classes, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, group, own = ParitySketcher(settings), None, None
        for batch in batches:
            u, v = [], []
            for centre, salt_, role, member, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                found = sketcher.shingles(text)
                if role == 0:
                    group, own = (centre, salt_), found
                elif group == (centre, salt_):
                    shared = len(np.intersect1d(own, found, assume_unique=True))
                    if 100 * shared >= settings.percent * (len(own) + len(found) - shared):
                        u.append(member)
                        v.append(centre)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    rows = wanted.join(texts, wanted["member"] == texts["node"]).select("centre", "salt", "role", "member", "text")
    return rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role").mapInArrow(run, "u long, v long")


def _verify_rest(pairs: DataFrame, components: DataFrame, classes: DataFrame, docs: DataFrame, settings: ParityJoin) -> DataFrame:
    """Links between members of one centre that are not in one component yet, as (u, v).

    What shares a sketch word shares the word's centre. Of the members of a
    centre, those outside its largest component are held against all others
    in groups of bounded size; Hamming distances come first there, too. Only
    confirmed links that join two components become rows.
    """
    under = pairs.unionByName(pairs.select(F.col("centre").alias("member"), "centre").distinct())
    under = under.join(components.select(F.col("node").alias("member"), "component"), "member", "left")
    under = materialize(under.select("centre", "member", F.coalesce("component", "member").alias("component")), "under-centres")
    sizes = under.groupBy("centre", "component").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("centre").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("n"))
    # The only pair of two members is that with the centre, which is settled.
    open_ = open_.where("n > most AND n > 2")
    grid = open_.select(
        "centre",
        "largest",
        F.ceil((F.col("n") - F.col("most")) / OUTSIDERS_PER_GROUP).cast("int").alias("rows"),
        F.ceil(F.col("n") / MEMBERS_PER_GROUP).cast("int").alias("columns"),
    )
    under = materialize(under.join(grid, "centre"), "open-centres")
    row, column = F.expr("CAST(pmod(xxhash64(member, 1), rows) AS INT)"), F.expr("CAST(pmod(xxhash64(member, 2), columns) AS INT)")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    outside = under.where("component <> largest").select("centre", row.alias("row"), each("columns").alias("column"), F.lit(0).alias("role"), "member", "component")
    wanted = outside.unionByName(under.select("centre", each("rows").alias("row"), column.alias("column"), F.lit(1).alias("role"), "member", "component"))
    texts = _class_texts(under.select(F.col("member").alias("node")).distinct(), classes, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, group, held, stack, joined = ParitySketcher(settings), None, [], None, {}
        for batch in batches:
            u, v = [], []
            for centre, row_, column_, role, member, component, text in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if group != (centre, row_, column_):
                    group, held, stack, joined = (centre, row_, column_), [], None, {}
                found = sketcher.shingles(text)
                if role == 0:
                    held.append((member, component, found))
                    continue
                if not held:
                    continue
                if stack is None:
                    words = min(settings.sketch_words(len(x[2])) for x in held)
                    stack = np.stack([sketcher.sketch(x[2], words) for x in held]), np.array([x[1] for x in held]), np.array([len(x[2]) for x in held])
                matrix, named, lengths = stack
                while component in joined:
                    component = joined[component]
                words = min(matrix.shape[1], settings.sketch_words(len(found)))
                mine = sketcher.sketch(found, words)
                theirs = matrix if words == matrix.shape[1] else np.bitwise_xor.reduce(matrix.reshape(len(matrix), -1, words), axis=1)
                apart = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64)
                near = (named != component) & (apart * (100 + settings.percent) <= (lengths + len(found)) * (100 - settings.percent))
                for i in np.flatnonzero(near).tolist():
                    if named[i] == component:
                        continue
                    shared = len(np.intersect1d(held[i][2], found, assume_unique=True))
                    if 100 * shared >= settings.percent * (int(lengths[i]) + len(found) - shared):
                        u.append(held[i][0])
                        v.append(member)
                        # The two components are one from here on; more links between them are not needed.
                        joined[int(named[i])] = component
                        named[named == named[i]] = component
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    rows = wanted.join(texts, wanted["member"] == texts["node"]).select("centre", "row", "column", "role", "member", "component", "text")
    return rows.repartition("centre", "row", "column").sortWithinPartitions("centre", "row", "column", "role").mapInArrow(run, "u long, v long")


def similar_documents(docs: DataFrame, settings: ParityJoin = ParityJoin()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Rows with equal sets are one class from the start, so copies are never
    compared. Under each shared sketch word the classes are held against the
    least of them, its centre; then those that share a centre and still are
    in different components against each other.

    A null or blank text has no shingles and stands alone. Rows that repeat
    an id are documents of their own; their ids do not link them. A row
    without doc_id takes part in links; it is returned with the least id it
    reaches, or null. Columns other than doc_id and text are not looked at.
    An empty table gives an empty result.
    """
    rows = materialize(parity_rows(docs, settings), "parity-rows")
    own = F.struct("doc_id", "text_key")
    classes = (
        rows.where("n_shingles > 0")
        .groupBy("set_a", "set_b")
        .agg(
            F.min("doc_id").alias("least"),
            F.min(own).alias("first"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("keys").alias("keys"),
            F.first("sketch").alias("sketch"),
        )
    )
    # The numbers are written with the classes, so they stay what they are.
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select(F.explode("keys").alias("word"), F.col("node").alias("member"))
    shared = members.groupBy("word").agg(F.min("member").alias("centre"), F.max("member").alias("last")).where("centre < last").select("word", "centre")
    pairs = materialize(members.join(shared, "word").where("member <> centre").select("member", "centre").distinct(), "word-pairs")
    links = materialize(_verify_centres(materialize(_sifted(pairs, classes, settings), "sifted"), classes, docs, settings), "links")
    found = materialize(connected_components(links), "components")
    more = materialize(_verify_rest(pairs, found, classes, docs, settings), "links")
    if not more.isEmpty():
        links = more.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v")))
        found = materialize(connected_components(links), "components")

    named = classes.select("set_a", "set_b", "node", "least").join(found, "node", "left")
    named = named.select("set_a", "set_b", F.coalesce("component", "node").alias("component"), "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("set_a", "set_b", "component_id")
    # A document without a set stays by itself and does not meet others in the join.
    result = rows.select("doc_id", "n_shingles", "set_a", "set_b").where("n_shingles > 0").join(named, ["set_a", "set_b"])
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return result.select("doc_id", "n_shingles", "component_id").unionByName(alone)
