"""Near copies by word shingles: MinHash bands propose, odd sketches sift, full sets confirm.

An odd sketch is a bitmap in which every MinHash sample flips one bit. The
bits in which two sketches differ count the samples that the documents do not
share, so a popcount of the XOR estimates a high similarity precisely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazarlens.llm.common import WordHashes, ascii_words, mix64
from bazarlens.llm.components import connected_components
from bazarlens.session import materialize

SLICE = 4096
MEMBERS_PER_TASK = 2000
OUTSIDERS_PER_TASK = 250


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters. With 40 bands of 5 samples a pair of similarity 0.8 is missed once in 8 million."""

    shingle_words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    sketch_words: int = 8

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def margin(self) -> float:
        """Least estimate that still goes to the exact check: six standard errors below the threshold."""
        least = self.percent / 100
        return least - 6 * (least * (1 - least) / self.samples) ** 0.5 - 0.05


class Sketcher:
    """Shingle sets, band keys and odd sketches of texts."""

    def __init__(self, settings: NearDuplicates):
        self.settings = settings
        self.words = WordHashes()
        generator = np.random.default_rng(20240229)
        self.factors = generator.integers(1, 1 << 63, settings.samples, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.offsets = generator.integers(0, 1 << 63, settings.samples, dtype=np.uint64)[:, None]
        self.sample_salt = mix64(np.arange(1, settings.samples + 1, dtype=np.uint64) << np.uint64(20))
        self.band_salt = mix64(np.arange(1, settings.bands + 1, dtype=np.uint64) << np.uint64(40))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the distinct shingles; a shorter text is one shingle, an empty one has none."""
        hashes = self.words.of(ascii_words(text))
        if not len(hashes):
            return hashes
        width = min(self.settings.shingle_words, len(hashes))
        count = len(hashes) - width + 1
        rolled = np.full(count, width, np.uint64)
        for i in range(width):
            rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count])
        return np.unique(rolled)

    def minhash(self, shingles: np.ndarray) -> np.ndarray:
        least = None
        for start in range(0, len(shingles), SLICE):
            part = shingles[None, start : start + SLICE] * self.factors
            part += self.offsets
            found = part.min(axis=1)
            least = found if least is None else np.minimum(least, found)
        return least

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        keys = self.band_salt.copy()
        for column in samples.reshape(self.settings.bands, self.settings.rows).T:
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + column)
        return keys.view(np.int64)

    def odd_sketch(self, samples: np.ndarray) -> np.ndarray:
        size = 64 * self.settings.sketch_words
        flipped = np.bincount((mix64(samples ^ self.sample_salt) % np.uint64(size)).astype(np.int64), minlength=size) & 1
        return np.packbits(flipped.astype(np.uint8)).view(np.int64)


SKETCH_SCHEMA = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): an id may repeat with another text, so a row is known by both."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def sketches(docs: DataFrame, settings: NearDuplicates) -> DataFrame:
    """One row per document: size and identity of its shingle set, band keys, odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(settings)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sizes, first, second, bands, odd = [], [], [], [], []
                for text in part.column(2).to_pylist():
                    found = sketcher.shingles(text)
                    sizes.append(len(found))
                    if not len(found):
                        for column in (first, second, bands, odd):
                            column.append(None)
                        continue
                    samples = sketcher.minhash(found)
                    place = np.arange(1, len(found) + 1, dtype=np.uint64)
                    first.append(int(mix64(found * np.uint64(0xD6E8FEB86659FD93) + place).sum().view(np.int64)))
                    second.append(int(mix64(found ^ mix64(place)).sum().view(np.int64)))
                    bands.append(sketcher.band_keys(samples))
                    odd.append(sketcher.odd_sketch(samples))
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64())]
                    + [pa.array(x, pa.list_(pa.int64())) for x in (bands, odd)],
                    names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    return _texts(docs).mapInArrow(run, SKETCH_SCHEMA)


def estimated_similarity(left: Column, right: Column, settings: NearDuplicates) -> Column:
    """Similarity from the differing bits of two odd sketches."""
    bits = 64 * settings.sketch_words
    differing = sum((F.bit_count(left[i].bitwiseXOR(right[i])) for i in range(settings.sketch_words)), F.lit(0))
    share = F.least(2.0 * differing / bits, F.lit(0.999))
    unshared = F.log(1 - share) * (-bits / 2)
    return 1 - unshared / (2 * settings.samples)


def _class_texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the wanted classes, one row each."""
    wanted = classes.join(nodes, "node").select(F.col("node").alias("id"), "first.doc_id", "first.text_key")
    texts = _texts(docs)
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_key"] == wanted["text_key"])
    return texts.join(wanted, same).select("id", "text").dropDuplicates(["id"])


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, settings: NearDuplicates) -> DataFrame:
    """The pairs (member, centre) whose full shingle sets are similar enough.

    Members travel to their centre, whose text is sent once to each task that
    holds up to ``MEMBERS_PER_TASK`` of its members; a task streams through
    its sorted rows and keeps one centre's set at a time.
    """
    spread = pairs.groupBy("centre").agg(F.ceil(F.count("*") / MEMBERS_PER_TASK).cast("int").alias("tasks"))
    members = pairs.join(spread, "centre").select("centre", F.expr("CAST(pmod(xxhash64(member), tasks) AS INT)").alias("task"), "member")
    centres = spread.select("centre", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.col("centre").alias("member"))
    wanted = members.unionByName(centres)
    texts = _class_texts(wanted.select(F.col("member").alias("node")).distinct(), classes, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, group, own = Sketcher(settings), None, None
        for batch in batches:
            u, v = [], []
            for centre, task, member, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if group != (centre, task):
                    group, own = (centre, task), None
                if member == centre:
                    own = sketcher.shingles(text)
                    continue
                found = sketcher.shingles(text)
                shared = len(np.intersect1d(own, found, assume_unique=True)) if own is not None else 0
                if shared and 100 * shared >= settings.percent * (len(own) + len(found) - shared):
                    u.append(member)
                    v.append(centre)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    rows = wanted.join(texts, F.col("member") == F.col("id")).select("centre", "task", "member", "text", (F.col("member") != F.col("centre")).alias("later"))
    return rows.repartition("centre", "task").sortWithinPartitions("centre", "task", "later").mapInArrow(run, "u long, v long")


def confirm_across(pairs: DataFrame, components: DataFrame, classes: DataFrame, docs: DataFrame, settings: NearDuplicates) -> DataFrame:
    """Links between members of one centre that are in different components, as (u, v).

    All that share a bucket share its centre. Under each centre the members
    outside its largest component are compared with all its members, in groups
    of up to ``OUTSIDERS_PER_TASK`` of the former and ``MEMBERS_PER_TASK`` of
    the latter; only confirmed links become rows, pairs never do. Two members
    of one component need no comparison.
    """
    under = pairs.unionByName(pairs.select(F.col("centre").alias("member"), "centre").distinct())
    named = components.select(F.col("node").alias("member"), "component")
    under = under.join(named, "member", "left").select("centre", "member", F.coalesce("component", "member").alias("component"))
    under = materialize(under, "under-centres")
    sizes = under.groupBy("centre", "component").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("centre").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("largest"), F.max("n").alias("inside"), F.sum("n").alias("n"))
    # With two members the only pair is that with the centre.
    groups = groups.where("n > inside AND n > 2").select(
        "centre",
        "largest",
        F.ceil((F.col("n") - F.col("inside")) / OUTSIDERS_PER_TASK).cast("int").alias("chunks"),
        F.ceil(F.col("n") / MEMBERS_PER_TASK).cast("int").alias("splits"),
    )
    under = under.join(groups, "centre")
    chunk, split = F.expr("CAST(pmod(xxhash64(member, 1), chunks) AS INT)"), F.expr("CAST(pmod(xxhash64(member, 2), splits) AS INT)")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    outside = under.where(F.col("component") != F.col("largest")).select("centre", chunk.alias("chunk"), every("splits").alias("split"), F.lit(0).alias("role"), "member", "component")
    inside = under.select("centre", every("chunks").alias("chunk"), split.alias("split"), F.lit(1).alias("role"), "member", "component")
    wanted = outside.unionByName(inside)
    texts = _class_texts(under.select(F.col("member").alias("node")).distinct(), classes, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, group = Sketcher(settings), None
        outsiders: list[tuple] = []
        index = None
        for batch in batches:
            u, v = [], []
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for centre, chunk_, split_, role, member, component, text in zip(*columns, strict=True):
                if group != (centre, chunk_, split_):
                    group, outsiders, index = (centre, chunk_, split_), [], None
                found = sketcher.shingles(text)
                if role == 0:
                    outsiders.append((member, component, found))
                    continue
                if not outsiders:
                    continue
                if index is None:
                    values = np.concatenate([x[2] for x in outsiders])
                    owners = np.repeat(np.arange(len(outsiders)), [len(x[2]) for x in outsiders])
                    order = np.argsort(values, kind="stable")
                    index = values[order], owners[order], np.array([x[1] for x in outsiders]), np.array([len(x[2]) for x in outsiders])
                values, owners, named_, lengths = index
                lo, hi = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
                many = hi - lo
                hit = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                shared = np.bincount(owners[hit], minlength=len(outsiders))
                near = 100 * shared >= settings.percent * (lengths + len(found) - shared)
                for i in np.flatnonzero(near & (named_ != component) & (shared > 0)).tolist():
                    u.append(outsiders[i][0])
                    v.append(member)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    rows = wanted.join(texts, F.col("member") == F.col("id")).select("centre", "chunk", "split", "role", "member", "component", "text")
    return rows.repartition("centre", "chunk", "split").sortWithinPartitions("centre", "chunk", "split", "role").mapInArrow(run, "u long, v long")


def _sift(pairs: DataFrame, classes: DataFrame, settings: NearDuplicates) -> DataFrame:
    """Drop pairs whose set sizes or odd sketches rule the similarity out."""
    side = lambda name: classes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch"))
    joined = pairs.join(side("member"), "member").join(side("centre"), "centre")
    sizes = F.least("member_n", "centre_n") * 100 >= settings.percent * F.greatest("member_n", "centre_n")
    similar = estimated_similarity(F.col("member_sketch"), F.col("centre_sketch"), settings) >= settings.margin
    return joined.where(sizes & similar).select("member", "centre")


def _components(docs: DataFrame, settings: NearDuplicates, through_ids: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with size and identity of their set, (set_a, set_b, component) of every set).

    ``through_ids``: the sets of one doc_id are linked as well.
    """
    rows = materialize(sketches(docs, settings), "sketches")
    with_set = rows.where("n_shingles > 0")
    classes = (
        with_set.groupBy("set_a", "set_b")
        .agg(
            F.min(F.struct("doc_id", "text_key")).alias("first"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        )
    )
    # Numbers of the classes; they are written with them, so they stay what they are.
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select(F.explode("bands").alias("bucket"), F.col("node").alias("member"))
    buckets = members.groupBy("bucket").agg(F.min("member").alias("centre"), F.max("member").alias("last")).where("centre < last").select("bucket", "centre")
    shared = materialize(members.join(buckets, "bucket"), "buckets")
    first = materialize(shared.where("member <> centre").select("member", "centre").distinct(), "under-centre")
    links = confirm(materialize(_sift(first, classes, settings), "pairs"), classes, docs, settings)
    if through_ids:
        of_ids = with_set.where("doc_id IS NOT NULL").join(classes.select("set_a", "set_b", "node"), ["set_a", "set_b"]).select("doc_id", "node").distinct()
        least = of_ids.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v < last").select("doc_id", "v")
        links = links.unionByName(of_ids.join(least, "doc_id").where("node <> v").select(F.col("node").alias("u"), "v"))
    links = materialize(links, "confirmed")
    found = materialize(connected_components(links), "components")

    # Second round: what meets in a bucket, and so under its centre, but is not in one component yet.
    more = materialize(confirm_across(first, found, classes, docs, settings), "confirmed")
    if not more.isEmpty():
        links = more.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v")))
        found = materialize(connected_components(links), "components")
    named = classes.select("set_a", "set_b", "node").join(found, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    return rows, named


def near_duplicates(docs: DataFrame, settings: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets are equal form a class at once. In every band
    bucket each class is compared with the least class, its centre; then, as
    far as the classes under a centre are still several components, those
    outside the largest with all the others, so no link that the bands propose
    is lost and a large group of near copies does not become all pairs.

    A null or blank text has no shingles and stands alone. A row without
    doc_id takes no part in links; it is returned with a null component and
    kept. Rows that repeat an id are returned each; of an id that repeats with
    other texts all sets are linked through the id. Columns other than doc_id
    and text are not looked at. An empty table gives an empty result.
    """
    rows, named = _components(docs.where("doc_id IS NOT NULL"), settings, through_ids=True)
    placed = rows.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    placed = materialize(placed.select("doc_id", "n_shingles", "component"), "placed")
    least = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # A document without a set stays by itself and does not meet others in the join.
    result = placed.where("component IS NOT NULL").join(least, "component").select("doc_id", "n_shingles", "component_id")
    alone = placed.where("component IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    without_id = sketches(docs.where("doc_id IS NULL"), settings).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    result = result.unionByName(alone).unionByName(without_id)
    return result.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_each(docs: DataFrame, settings: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row of each group of near copies, with all its columns; rows without shingles all stay.

    That of the least doc_id stays, among rows without an id one of them; of
    rows that are equal in id and text one stays. An id says nothing about
    copies here: rows of one id with unlike texts both stay.
    """
    rows, named = _components(docs, settings, through_ids=False)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key").alias("key")
    keyed = rows.where("n_shingles > 0").join(named, ["set_a", "set_b"]).groupBy("component", key).agg(F.count("*").alias("n"))
    keyed = materialize(keyed, "keyed")
    best = keyed.groupBy("component").agg(F.min("key").alias("key"))
    # Of equal rows one stays; such rows are few, so only they are brought together.
    repeated = keyed.where("n > 1").select("key").join(best.select("key"), "key", "left_semi")
    repeated = materialize(repeated, "repeated")
    gone = keyed.select("key").join(best.select("key"), "key", "left_anti").unionByName(repeated)
    own = F.struct(F.col("doc_id").cast("long").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    rows_of = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("key"))
    kept = rows_of.join(gone, "key", "left_anti").select("row")
    if not repeated.isEmpty():
        place = F.row_number().over(Window.partitionBy("key").orderBy("key"))
        kept = kept.unionByName(rows_of.join(repeated, "key", "left_semi").withColumn("place", place).where("place = 1").select("row"))
    return kept.select("row.*")
