"""Token ids in compressed binary blocks: context mixing in front of a range coder.

A block holds the ids of whole documents and can be read alone. Its ids are
cut into lanes of equal length that are coded side by side, each with a range
coder of its own, while all lanes share and teach one model. For every id the
model has a guess from the two ids before it (order 2), one from the id before
it (order 1) and the counts so far (order 0). Whether a guess is right is
coded with a probability mixed from the three orders, by weights that learn;
an id that nobody guessed is coded by the counts. All of the model's arithmetic
is on integers, so a block is read back alike on every machine.

Block layout (little endian): magic ``IDB1``; crc32 of all that follows; number of
ids, documents, lanes, distinct ids; length of the packed directory and
dictionary; the directory and dictionary; bytes per lane; the lanes.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazarlens.llm.words import PieceCache
from bazarlens.session import fresh_path

MAGIC = b"IDB1"
HEADER = struct.Struct("<4sIQIIII")
# Fewer lanes and longer blocks let contexts come back: 7.6 bits an id on the 0.1 table, 8.3 by the counts alone.
BLOCK_IDS = 1 << 22
LANES = 4096
# Counts of a block are 32-bit numbers, 16 for each id.
MOST_IDS = 1 << 26
LEAST_STEPS = 64
ORDER2_BITS = 20
BOTTOM = np.uint64(1 << 32)
CLOSE = np.uint64(1 << 48)
U12, U16, U32, U48 = np.uint64(12), np.uint64(16), np.uint64(32), np.uint64(48)
LOW32, ZERO, ONE = np.uint64((1 << 32) - 1), np.uint64(0), np.uint64(4096)

#: Logistic tables over 12-bit probabilities, and their inverse, in units of 1/256.
STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], np.int32)
SQUASH_LIMIT = 2047
SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-SQUASH_LIMIT, SQUASH_LIMIT + 1)], np.int32)


class _Writer:
    """Range encoders of all lanes; ``lanes`` says which take part in a call."""

    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, ~np.uint64(0))
        # 16-bit units; grown when needed.
        self.out = np.zeros((lanes, steps + 16), np.uint16)
        self.place = np.zeros(lanes, np.int64)

    def _room(self) -> None:
        if self.place.max() + 4 >= self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)

    def code(self, lanes, start, size, unit) -> None:
        """Narrow to ``[start, start + size)`` of a total whose one part is ``unit`` wide."""
        low = self.low[lanes] + start * unit
        width = size * unit
        everyone = isinstance(lanes, slice)
        while True:
            close = (low ^ (low + width)) < CLOSE
            move = np.flatnonzero(close | (width < BOTTOM))
            if not len(move):
                break
            part, span = low[move], width[move]
            span = np.where(close[move], span, -part & LOW32)
            who = move if everyone else lanes[move]
            self._room()
            place = self.place[who]
            self.out[who, place] = (part >> U48).astype(np.uint16)
            self.place[who] = place + 1
            low[move], width[move] = part << U16, span << U16
        self.low[lanes], self.range[lanes] = low, width

    def bit(self, lanes, bits, chance) -> None:
        """Bits that are one with a probability of ``chance`` / 4096."""
        chance = chance.astype(np.uint64)
        self.code(lanes, np.where(bits, ZERO, chance), np.where(bits, chance, ONE - chance), self.range[lanes] >> U12)

    def symbol(self, lanes, start, size, total) -> None:
        self.code(lanes, start.astype(np.uint64), size.astype(np.uint64), self.range[lanes] // np.uint64(total))

    def finish(self) -> list[bytes]:
        """The range is at least 2**32 wide, so a multiple of that lies in it; a reader takes the rest as zeros."""
        value = self.low + (self.range - np.uint64(1))
        lanes = np.arange(len(self.low))
        for shift in (U48, U32):
            self._room()
            self.out[lanes, self.place] = (value >> shift).astype(np.uint16)
            self.place += 1
        return [row[:n].astype("<u2").tobytes() for row, n in zip(self.out, self.place.tolist(), strict=True)]


class _Reader:
    """Range decoders of all lanes."""

    def __init__(self, lanes: list[bytes]):
        longest = max(map(len, lanes)) // 2 + 8
        self.data = np.zeros((len(lanes), longest), np.uint16)
        for i, lane in enumerate(lanes):
            self.data[i, : len(lane) // 2] = np.frombuffer(lane, "<u2")
        self.low = np.zeros(len(lanes), np.uint64)
        self.range = np.full(len(lanes), ~np.uint64(0))
        first = self.data[:, :4].astype(np.uint64)
        self.value = (first[:, 0] << U48) | (first[:, 1] << U32) | (first[:, 2] << U16) | first[:, 3]
        self.place = np.full(len(lanes), 4, np.int64)

    def settle(self, lanes, low, value, start, size, unit) -> None:
        low, width = low + start * unit, size * unit
        everyone = isinstance(lanes, slice)
        while True:
            close = (low ^ (low + width)) < CLOSE
            move = np.flatnonzero(close | (width < BOTTOM))
            if not len(move):
                break
            part, span = low[move], width[move]
            span = np.where(close[move], span, -part & LOW32)
            who = move if everyone else lanes[move]
            place = self.place[who]
            self.place[who] = place + 1
            value[move] = (value[move] << U16) | self.data[who, np.minimum(place, self.data.shape[1] - 1)]
            low[move], width[move] = part << U16, span << U16
        self.low[lanes], self.range[lanes], self.value[lanes] = low, width, value

    def bit(self, lanes, chance):
        unit = self.range[lanes] >> U12
        low, value, chance = self.low[lanes], self.value[lanes].copy(), chance.astype(np.uint64)
        bits = value - low < chance * unit
        self.settle(lanes, low, value, np.where(bits, ZERO, chance), np.where(bits, chance, ONE - chance), unit)
        return bits

    def symbol(self, lanes, cumulated, total):
        unit = self.range[lanes] // np.uint64(total)
        low, value = self.low[lanes], self.value[lanes].copy()
        target = np.minimum((value - low) // unit, np.uint64(total - 1)).astype(cumulated.dtype)
        found = np.searchsorted(cumulated, target, side="right") - 1
        start = cumulated[found]
        self.settle(lanes, low, value, start.astype(np.uint64), (cumulated[found + 1] - start).astype(np.uint64), unit)
        return found


class _Mixer:
    """A learned blend of three logistic inputs for each of 16 sets, in whole numbers."""

    def __init__(self):
        self.weights = [np.full(16, w, np.int32) for w in (26000, 20000, 8000)]

    def chance(self, inputs: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
        total = sum(x * w[chosen] for x, w in zip(inputs, self.weights, strict=True)) >> 16
        return SQUASH[np.clip(total, -SQUASH_LIMIT, SQUASH_LIMIT) + SQUASH_LIMIT]

    def learn(self, inputs, chosen, chance, bits) -> None:
        """From the first lanes of a step, which are as good as any others."""
        some = slice(0, 1024)
        chosen = chosen[some]
        error = np.where(bits[some], 4096, 0) - chance[some]
        count = np.maximum(np.bincount(chosen, minlength=16), 1)
        for x, w in zip(inputs, self.weights, strict=True):
            # The products are whole numbers below 2**53, so these sums are exact.
            gradient = np.bincount(chosen, weights=x[some] * error, minlength=16).astype(np.int64)
            w += (gradient // count >> 8).astype(np.int32)


class _Chances:
    """Adaptive 16-bit probabilities of 256 states, moved by the share of hits of a step."""

    def __init__(self):
        self.p = np.full(256, 1 << 14, np.int64)
        self._table()

    def _table(self) -> None:
        self.stretched = STRETCH[self.p >> 4]

    def learn(self, state: np.ndarray, bits: np.ndarray) -> None:
        seen = np.bincount(state, minlength=256)
        hits = np.bincount(state[bits], minlength=256)
        target = 65535 * hits // np.maximum(seen, 1)
        self.p += (target - self.p) * np.minimum(seen, 48) // 64
        self._table()


class Model:
    """What the lanes share. ``step`` codes one id per lane, through ``coder``.

    A slot of the order-1 and order-2 tables holds 16 times the expected id
    plus how far it is trusted, from 0 to 15.
    """

    def __init__(self, alphabet: int, lanes: int):
        self.alphabet = alphabet
        self.counts = np.ones(alphabet, np.int32)
        self.total = alphabet
        self.slots1 = np.zeros(alphabet + 1, np.int32)
        self.slots2 = np.zeros(1 << ORDER2_BITS, np.int32)
        self.second, self.first = _Chances(), _Chances()
        self.mix2, self.mix1 = _Mixer(), _Mixer()
        self.one = np.full(lanes, alphabet, np.int64)
        self.two = np.full(lanes, alphabet, np.int64)

    def _zero_order(self, symbol: np.ndarray) -> np.ndarray:
        return STRETCH[np.minimum((self.counts[symbol].astype(np.int64) << 12) // self.total, 4095)]

    @staticmethod
    def _learned(guess, trust, ids) -> np.ndarray:
        """A trusted guess survives some misses; another one is replaced."""
        hit = guess == ids
        kept = hit | (trust > 3)
        return np.where(kept, guess, ids) * 16 + np.where(hit, np.minimum(trust + 1, 15), np.where(kept, trust >> 1, 0))

    def step(self, lanes, coder, known: np.ndarray | None) -> np.ndarray:
        """Code (``known`` given) or read the next id of ``lanes``, a slice or numbers; returns the ids."""
        one, two = self.one[lanes], self.two[lanes]
        slot = ((one * 0x9E3779B1 + two * 0x85EBCA77) >> 7) & ((1 << ORDER2_BITS) - 1)
        held2, held1 = self.slots2[slot], self.slots1[one]
        guess2, trust2, guess1, trust1 = held2 >> 4, held2 & 15, held1 >> 4, held1 & 15
        agree = guess1 == guess2
        # Is it what order 2 expects?
        state2 = trust2 * 16 + trust1 * agree
        second = self.first.stretched[trust1 * 16]
        inputs = [self.second.stretched[state2], np.where(agree, second, -second >> 1), self._zero_order(guess2)]
        chance = self.mix2.chance(inputs, trust2)
        if known is None:
            right2 = coder.bit(lanes, chance)
        else:
            right2 = known == guess2
            coder.bit(lanes, right2, chance)
        self.mix2.learn(inputs, trust2, chance, right2)
        self.second.learn(state2, right2)
        # If not: is it what order 1 expects?
        numbers = np.arange(len(one)) if isinstance(lanes, slice) else lanes
        ids = guess2.astype(np.int64)
        missed = ~right2
        ask = np.flatnonzero(missed & ~agree)
        if len(ask):
            sure, guess = trust1[ask], guess1[ask]
            state1 = sure * 16 + trust2[ask]
            inputs = [self.first.stretched[state1], second[ask], self._zero_order(guess)]
            chance = self.mix1.chance(inputs, sure)
            if known is None:
                right1 = coder.bit(numbers[ask], chance)
            else:
                right1 = known[ask] == guess
                coder.bit(numbers[ask], right1, chance)
            self.mix1.learn(inputs, sure, chance, right1)
            self.first.learn(state1, right1)
            found = ask[right1]
            ids[found] = guess[right1]
            missed[found] = False
        # If not: by the counts.
        rest = np.flatnonzero(missed)
        if len(rest):
            cumulated = np.zeros(self.alphabet + 1, np.int32)
            np.cumsum(self.counts, out=cumulated[1:])
            if known is None:
                ids[rest] = coder.symbol(numbers[rest], cumulated, self.total)
            else:
                ids[rest] = some = known[rest]
                coder.symbol(numbers[rest], cumulated[some], self.counts[some], self.total)
        # Learn. Of several lanes in one context the last one's id counts.
        self.slots2[slot] = self._learned(guess2, trust2, ids)
        self.slots1[one] = self._learned(guess1, trust1, ids)
        self.counts += (16 * np.bincount(ids, minlength=self.alphabet)).astype(np.int32)
        self.total += 16 * len(ids)
        self.two[lanes], self.one[lanes] = one, ids
        return ids


def _lane_shape(count: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, count // LEAST_STEPS))
    return lanes, -(-count // lanes)


def pack_block(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    """One block from the ids of whole documents, 2^26 ids at most."""
    if sum(map(len, ids)) > MOST_IDS:
        raise ValueError("too many ids for one block")
    lengths = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    values, dense = np.unique(flat, return_inverse=True)
    count = len(dense)
    steps_of = np.concatenate([np.diff(values.astype(np.int64), prepend=0)]).astype("<u4")
    side = zlib.compress(np.array(doc_ids, "<i8").tobytes() + lengths.astype("<i8").tobytes() + steps_of.tobytes(), 1)
    lanes, steps = _lane_shape(count)
    streams: list[bytes] = []
    if count:
        writer, model = _Writer(lanes, steps), Model(len(values), lanes)
        table = np.full(lanes * steps, -1, np.int64)
        table[:count] = dense
        table = np.ascontiguousarray(table.reshape(lanes, steps).T)
        for row in table:
            if row[-1] >= 0:
                model.step(slice(None), writer, row)
            else:
                here = np.flatnonzero(row >= 0)
                model.step(here, writer, row[here])
        streams = writer.finish()
    sizes = np.array([len(x) for x in streams], "<u4").tobytes()
    body = side + sizes + b"".join(streams)
    header = HEADER.pack(MAGIC, 0, count, len(doc_ids), len(streams), len(values), len(side))
    return header[:4] + struct.pack("<I", zlib.crc32(header[8:] + body)) + header[8:] + body


def unpack_block(block: bytes) -> tuple[list[int], list[np.ndarray]]:
    """Document ids and the ids of each; raises if the block is damaged."""
    if len(block) < HEADER.size or block[:4] != MAGIC:
        raise ValueError("no block of token ids")
    _, crc, count, docs, lanes, alphabet, side_size = HEADER.unpack_from(block)
    if zlib.crc32(memoryview(block)[8:]) != crc:
        raise ValueError("damaged block of token ids")
    at = HEADER.size + side_size
    side = zlib.decompress(block[HEADER.size : at])
    doc_ids = np.frombuffer(side, "<i8", docs).tolist()
    lengths = np.frombuffer(side, "<i8", docs, 8 * docs)
    values = np.cumsum(np.frombuffer(side, "<u4", alphabet, 16 * docs), dtype=np.int64)
    dense = np.zeros(0, np.int64)
    if count:
        sizes = np.frombuffer(block, "<u4", lanes, at).tolist()
        at += 4 * lanes
        streams = []
        for n in sizes:
            streams.append(block[at : at + n])
            at += n
        reader, model = _Reader(streams), Model(alphabet, lanes)
        _, steps = _lane_shape(count)
        table = np.zeros((steps, lanes), np.int64)
        begins = np.arange(lanes) * steps
        for step in range(steps):
            here = slice(None) if begins[-1] + step < count else np.flatnonzero(begins + step < count)
            table[step, here] = model.step(here, reader, None)
        dense = table.T.reshape(-1)[:count]
    flat = values[dense].astype(np.uint32) if count else np.zeros(0, np.uint32)
    cuts = np.cumsum(lengths)
    return doc_ids, np.split(flat, cuts[:-1]) if docs else []


_TOKENIZERS: dict[str, object] = {}


def tokenizer_cache(path: str) -> PieceCache:
    """Ids per piece by the tokenizers library, kept per Python worker."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True

        feed = tokenizer.encode("\n", add_special_tokens=False).ids

        def encode(texts: list[str]) -> list[bytes]:
            found: list[bytes] = []
            for start in range(0, len(texts), 5000):
                some = texts[start : start + 5000]
                if len(feed) != 1 or any("\n" in x for x in some):
                    found.extend(np.array(x.ids, np.int32).tobytes() for x in tokenizer.encode_batch_fast(some, add_special_tokens=False))
                    continue
                # Words are encoded as the lines of one text: a line feed between them is one id that no word has.
                ids = np.array(tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, np.int32)
                flat, cuts = ids.tobytes(), np.flatnonzero(ids == feed[0])
                found.extend([flat[4 * i : 4 * j] for i, j in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)])
            return found

        _TOKENIZERS[path] = PieceCache(encode, 700_000)
    return _TOKENIZERS[path]


def write_ids(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encode texts and write blocks to ``path``, documents in ascending doc_id order.

    The table at ``path`` has a row per block: part and number of the block,
    its number of ids, the block. Parts are ranges of doc_id; a part holds
    its documents in order, so a reader needs one part at a time. A null or
    empty text is the end id alone. Rows that repeat a doc_id are stored
    each, in no set order among themselves; rows without doc_id are not
    stored, as the format has no place for them. Blocks end with a document:
    a task holds ``block_ids`` ids, or one document where that is longer, at
    some 60 bytes an id while it is packed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    rows = rows.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tokenizer_cache(vocabulary)
        held_ids: list[int] = []
        held: list[np.ndarray] = []
        size = number = part = 0
        end = np.array([end_id], np.int32)

        def flush():
            nonlocal held_ids, held, size, number
            block = pack_block(held_ids, held)
            row = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([block], pa.binary())],
                names=["part", "block_no", "n_ids", "block"],
            )
            held_ids, held, size, number = [], [], 0, number + 1
            return row

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                part = some.column(2)[0].as_py()
                texts = [x or "" for x in some.column(1).to_pylist()]
                for doc, values in zip(some.column(0).to_pylist(), cache.values(texts), strict=True):
                    ids = np.append(np.frombuffer(b"".join(values), np.int32), end)
                    if size and size + len(ids) > block_ids:
                        yield flush()
                    held_ids.append(doc)
                    held.append(ids)
                    size += len(ids)
        if size:
            yield flush()

    rows.mapInArrow(run, "part int, block_no int, n_ids long, block binary").write.parquet(path)


def read_ids(spark, path: str, with_ids: bool = True) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids."""
    blocks = spark.read.schema("part int, block_no int, n_ids long, block binary").parquet(path)
    # One number per part and one running sum within each: nothing here grows with the documents.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("shard", F.floor(F.col("part") / 4096))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = parts.groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("inside", inside).join(shards.select("shard", before.alias("before")), "shard").select("part", (F.col("inside") + F.col("before")).alias("base"))
    numbers = blocks.select("part", "block_no", "n_ids")
    running = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = numbers.withColumn("running", running).join(parts, "part").select("part", "block_no", (F.col("base") + F.col("running")).alias("first_start"))
    rows = blocks.join(offsets, ["part", "block_no"]).select("first_start", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start = batch.column(0)[i].as_py()
                doc_ids, ids = unpack_block(batch.column(1)[i].as_py())
                lengths = np.array([len(x) for x in ids], np.int64)
                starts = start + np.cumsum(lengths) - lengths
                crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def stored_ids(docs: DataFrame, vocabulary: str, end_id: int = 2, with_ids: bool = False, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and read them back."""
    path = fresh_path(docs.sparkSession, "ids")
    write_ids(docs, vocabulary, path, end_id, block_ids)
    return read_ids(docs.sparkSession, path, with_ids)
