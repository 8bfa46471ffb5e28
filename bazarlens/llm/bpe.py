"""Byte-level BPE by prefix dynamic programming, and decoding.

Every prefix of a byte string has one encoding, and that encoding has one last
token: the token that ends the prefix and may follow the last token of the
prefix in front of it. Two tokens may stand side by side if merging them anew
from their bytes leaves the border between them in place. Storing the last
token of each prefix is a table that can be appended to, and that an edit
leaves valid up to where it starts.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlens.llm.words import PieceCache


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file of one vocabulary (a bounded file)."""
    lines = open(path, "rb").read().split(b"\n")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


class Vocabulary:
    """Tables over the tokens: how each came about by a merge, and a trie of their bytes.

    A token that the merges never produce can only be a whole match; it gets
    no place in the trie.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.ids_of = {token: np.int32(rank).tobytes() for token, rank in ranks.items()}
        self.decimal = [str(rank) for rank in range(self.size)]
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        keys, merged = [], []
        usable = np.zeros(self.size, bool)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                usable[rank] = True
                continue
            parts = self._merged_below(token, rank)
            if len(parts) == 2:
                usable[rank] = True
                self.left[rank], self.right[rank] = parts
                keys.append(parts[0] * self.size + parts[1])
                merged.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.array(merged, np.int64)[order], self.size)
        self.pair_hashes = np.zeros(1 << 22, bool)
        self.pair_hashes[self._hash(self.pair_keys)] = True
        self._build_trie(usable)

    @staticmethod
    def _hash(pairs: np.ndarray) -> np.ndarray:
        """22 bits of each pair's key; the product may overflow."""
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)

    def _merged_below(self, token: bytes, limit: int) -> list[int]:
        """Ranks of the parts that merges of a rank under ``limit`` leave."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= limit:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks.get(x, -1) for x in parts]

    def _build_trie(self, usable: np.ndarray) -> None:
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for rank in np.flatnonzero(usable):
            node = 0
            for byte in self.bytes[rank]:
                nxt = children[node].get(byte)
                if nxt is None:
                    nxt = children[node][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                node = nxt
            ends[node] = int(rank)
        # Inner nodes first, so that the dense table has no rows for leaves.
        inner = [i for i, x in enumerate(children) if x]
        place = np.full(len(children), -1, np.int64)
        place[inner] = np.arange(len(inner))
        leaves = [i for i, x in enumerate(children) if not x]
        place[leaves] = np.arange(len(inner), len(children))
        self.inner = len(inner)
        self.child = np.full((len(inner), 256), -1, np.int32)
        for i in inner:
            for byte, nxt in children[i].items():
                self.child[place[i], byte] = place[nxt]
        self.ends = np.empty(len(children), np.int32)
        self.ends[place] = ends

    def may_follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border between two tokens, elementwise.

        Both tokens are taken apart from the border outward, latest merge
        first. A pair at the border that merges earlier than the parts at hand
        came about would have been merged first.
        """
        ok = np.ones(len(first), bool)
        at = np.arange(len(first))
        a, b = first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(a), self.size, np.int64)
        while len(at):
            key = a * self.size + b
            # Most pairs never merge, which a look at their hash tells.
            maybe = np.flatnonzero(self.pair_hashes[self._hash(key)])
            found = np.searchsorted(self.pair_keys, key[maybe])
            bad = np.zeros(len(at), bool)
            bad[maybe] = np.where(self.pair_keys[found] == key[maybe], self.pair_rank[found], self.size) < limit[maybe]
            ok[at[bad]] = False
            splits_a, splits_b = self.left[a] >= 0, self.left[b] >= 0
            go = ~bad & (splits_a | splits_b)
            at, a, b, splits_a, splits_b = at[go], a[go], b[go], splits_a[go], splits_b[go]
            # The later of the two merges is undone. Of equal ones the right token's:
            # from the left the first merge is done first, so it may not cross at its own rank.
            undo_b = splits_b & ((b >= a) | ~splits_a)
            limit = np.where(undo_b, b + 1, a)
            a, b = np.where(undo_b, a, self.right[a]), np.where(undo_b, self.left[b], b)
        return ok

    def tokens_from(self, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For lengths 1, 2, ...: (row, start, token) of all tokens in the rows of ``data``, ended by byte -1."""
        rows, starts = np.nonzero(data >= 0)
        node = np.zeros(len(rows), np.int64)
        width, found, length = data.shape[1], [], 0
        while len(rows):
            byte = data[rows, np.minimum(starts + length, width - 1)]
            go = (node < self.inner) & (byte >= 0) & (starts + length < width)
            rows, starts, node, byte = rows[go], starts[go], node[go], byte[go]
            node = self.child[node, byte].astype(np.int64)
            go = node >= 0
            rows, starts, node = rows[go], starts[go], node[go]
            length += 1
            token = self.ends[node]
            hit = token >= 0
            found.append((rows[hit], starts[hit], token[hit]))
        return found

    def last_tokens(self, pieces: list[bytes]) -> np.ndarray:
        """The table: row i, column j is the last token of the first j bytes of piece i, -1 beyond its end."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths.max())
        data = np.full((len(pieces), width), -1, np.int16)
        data[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        last = np.full((len(pieces), width + 1), -1, np.int32)
        by_end: list[list] = [[] for _ in range(width + 1)]
        for length, (rows, starts, tokens) in enumerate(self.tokens_from(data), 1):
            ends = starts + length
            order = np.argsort(ends, kind="stable")
            rows, ends, tokens = rows[order], ends[order], tokens[order]
            cuts = np.searchsorted(ends, np.arange(width + 2))
            for end in range(length, width + 1):
                if cuts[end] < cuts[end + 1]:
                    by_end[end].append((length, rows[cuts[end] : cuts[end + 1]], tokens[cuts[end] : cuts[end + 1]]))
        for end in range(1, width + 1):
            for length, rows, tokens in reversed(by_end[end]):
                open_ = last[rows, end] < 0
                rows, tokens = rows[open_], tokens[open_]
                if length < end:
                    fits = self.may_follow(last[rows, end - length], tokens)
                    rows, tokens = rows[fits], tokens[fits]
                last[rows, end] = tokens
        return last

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as 32-bit integers; a piece that is a token is that token."""
        result: list[bytes | None] = [self.ids_of[x] if x in self.ids_of else (b"" if not x else None) for x in pieces]
        rest = np.array([i for i, x in enumerate(result) if x is None], np.int64)
        lengths = np.array([len(pieces[i]) for i in rest.tolist()], np.int64)
        order = np.argsort(lengths, kind="stable")
        rest, lengths = rest[order], lengths[order]
        start = 0
        while start < len(rest):
            # Pieces of like length side by side; a table of bounded size at once.
            alike = min(int(np.searchsorted(lengths, 2 * lengths[start] + 4, side="right")), start + 400_000)
            cells = np.arange(1, alike - start + 1) * (lengths[start:alike] + 1)
            stop = start + max(1, int(np.searchsorted(cells, 400_000, side="right")))
            group = rest[start:stop].tolist()
            for i, ids in zip(group, self._walk_back(self.last_tokens([pieces[i] for i in group]), lengths[start:stop]), strict=True):
                result[i] = ids
            start = stop
        return result

    def _walk_back(self, last: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        place, rows, steps = lengths.copy(), np.arange(len(lengths)), []
        while (place > 0).any():
            token = np.where(place > 0, last[rows, place], -1)
            steps.append(token)
            place = place - np.where(token >= 0, self.length[token], 0)
        table = np.stack(steps[::-1], axis=1).astype(np.int32)
        used = table >= 0
        flat = table[used].tobytes()
        ends = (4 * np.cumsum(used.sum(axis=1))).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class PrefixTable:
    """Last tokens of the prefixes of one byte string, kept up to date under appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.longest = int(vocabulary.length.max())
        self.append(data)

    def append(self, data: bytes) -> None:
        """Exact: no stored entry changes."""
        start, self.data = len(self.data), self.data + data
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._last(end))

    def _last(self, end: int) -> int:
        vocabulary = self.vocabulary
        for start in range(max(0, end - self.longest), end):
            token = vocabulary.ranks.get(self.data[start:end])
            if token is None or (end - start > 1 and vocabulary.left[token] < 0):
                continue
            if start == 0 or vocabulary.may_follow(np.array([self.last[start]]), np.array([token]))[0]:
                return token
        raise ValueError("a byte has no token")

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in the place of [start, stop); returns how many prefixes were computed anew.

        Entries up to ``start`` stay. Behind the edit they are computed anew
        until as many as the longest token has bytes in a row came out as they
        were; then all later ones are as they were, too.
        """
        tail, old = self.data[stop:], self.last[stop:]
        self.data = self.data[:start] + data + tail
        self.last = self.last[: start + 1]
        same, done = 0, 0
        for end in range(start + 1, len(self.data) + 1):
            at = end - start - len(data)
            self.last.append(self._last(end))
            done += 1
            same = same + 1 if at >= 0 and self.last[-1] == old[at] else 0
            if same >= self.longest:
                self.last.extend(old[at + 1 :])
                break
        return done

    def ids(self) -> list[int]:
        """Tokens of the whole string, read from the end."""
        place, found = len(self.data), []
        while place:
            found.append(self.last[place])
            place -= int(self.vocabulary.length[found[-1]])
        return found[::-1]


class TextEncoder:
    """Whole texts to ids: the pattern's matches are encoded apart from each other."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 400_000):
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.limit = limit

    def matches(self, text: str) -> list[str]:
        """The pattern's matches; a word of letters, and a full stop or comma behind it, need no search."""
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            return [text]
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.pattern.findall(text)

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
        split = list(map(self.matches, texts))
        new = list({x for parts in split for x in parts if x not in known})
        known.update(zip(new, self.vocabulary.encode([x.encode() for x in new]), strict=True))
        return [known[parts[0]] if len(parts) == 1 else b"".join([known[x] for x in parts]) for parts in split]

    def cached(self) -> PieceCache:
        return PieceCache(self.encode_pieces, self.limit)


def _in_slices(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of batches of about so many characters; a longer text is a part of its own."""
    for batch in batches:
        lengths = np.array([len(x) if x else 0 for x in batch.column(1).to_pylist()])
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + chars, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_ENCODERS: dict[int, TextEncoder] = {}


def encoder_of(number: int, ranks: dict[bytes, int], pattern: str, limit: int) -> TextEncoder:
    """One encoder per Python worker, for the vocabulary and pattern of that checksum."""
    if number not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[number] = TextEncoder(ranks, pattern, limit)
    return _ENCODERS[number]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = True, remember: int = 400_000) -> DataFrame:
    """One row per document: doc_id, ids (if wanted), n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no ids, and the digests of no bytes. Rows
    are encoded each for itself, so ids that are null or repeat are returned
    as they are; other columns are not looked at. ``decoded_sha256`` is taken
    from the bytes that decoding the ids gives back. The vocabulary is
    broadcast; its size does not depend on the data. A Python worker remembers
    the ids of up to twice ``remember`` words, some 200 bytes each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    number = zlib.crc32(repr((sorted(ranks.items()), pattern, remember)).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(number, shared.value, pattern, remember)
        cache, decode, decimal = encoder.cached(), encoder.vocabulary.decode, encoder.vocabulary.decimal
        for part in _in_slices(batches):
            rows = []
            for values in cache.values([x or "" for x in part.column(1).to_pylist()]):
                ids = np.frombuffer(b"".join(values), np.int32)
                listed = ids.tolist()
                written = ",".join(map(decimal.__getitem__, listed))
                rows.append((ids if with_ids else None, len(ids), _sha256(written.encode()), _sha256(decode(listed))))
            ids, counts, first, second = (list(x) for x in zip(*rows, strict=True))
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(first), pa.array(second)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); a null list is the empty text, bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in shared.value.items()}
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, ids or ())).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
