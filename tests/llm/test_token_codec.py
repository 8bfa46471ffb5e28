import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bazarlens.llm import token_codec
from tests.llm.support import clashing, documents


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=200), max_size=6))
def test_blocks_come_back(lists):
    ids = [np.array(x, np.int64) for x in lists]
    numbers, back = token_codec.unpack_block(token_codec.pack_block(list(range(len(ids))), ids))
    assert numbers == list(range(len(ids))) and [x.tolist() for x in back] == lists


def test_large_block_is_small_and_exact():
    random.seed(1)
    words = [[random.randint(0, 50000) for _ in range(random.randint(1, 4))] for _ in range(300)]
    ids = np.array([t for _ in range(60_000) for t in random.choice(words)], np.int64)
    block = token_codec.pack_block([-5], [ids])
    assert (token_codec.unpack_block(block)[1][0] == ids).all()
    assert len(block) < len(ids)


def test_mixing_earns_its_keep():
    """Bits per id are at least 5 % under what the counts of the ids alone can give."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = token_codec.tokenizer_cache(path)
    texts = [t or "" for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()]
    ids = [np.frombuffer(b"".join(v), np.int32) for v in cache.values(texts)]
    flat = np.concatenate(ids)
    share = np.unique(flat, return_counts=True)[1] / len(flat)
    entropy = -(share * np.log2(share)).sum()
    block = token_codec.pack_block(list(range(len(ids))), ids)
    assert 8 * len(block) / len(flat) <= 0.95 * entropy
    assert (np.concatenate(token_codec.unpack_block(block)[1]) == flat).all()


def test_text_longer_than_a_block_and_full_blocks(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark, ["a b c", "long " * 3000, "x", "y z", None, "w " * 40])
    whole = {r["doc_id"]: tuple(r) for r in token_codec.stored_ids(docs, path).collect()}
    small = token_codec.stored_ids(docs, path, block_ids=20)
    assert {r["doc_id"]: tuple(r) for r in small.collect()} == whole and len(whole) == 6
    monkeypatch.setattr(token_codec, "MOST_IDS", 5)
    with pytest.raises(ValueError):
        token_codec.pack_block([1], [np.arange(6)])


def test_damage_is_noticed():
    block = bytearray(token_codec.pack_block([1], [np.arange(500)]))
    for at in (5, 30, len(block) // 2, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            token_codec.unpack_block(bytes(broken))
    with pytest.raises(ValueError):
        token_codec.unpack_block(b"")


def test_documents_in_order(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    texts = ["the cat", "", None, "a\nb  c <|endoftext|>", "日本 " * 50, "word " * 30000, "x"]
    rows = list(enumerate(texts, -2))
    random.Random(3).shuffle(rows)
    result = {r["doc_id"]: r for r in token_codec.stored_ids(clashing(documents(spark, [*rows, (None, "z")])), path, with_ids=True).collect()}
    assert len(result) == len(texts)
    start = 0
    for number, text in sorted(rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        row = result[number]
        assert list(row["ids"]) == ids and row["n_tokens"] == len(ids) and row["start"] == start
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_codec.stored_ids(documents(spark, []), path).count() == 0


def test_repeated_ids_are_stored_each(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_codec.stored_ids(documents(spark, [(1, "a"), (1, "a"), (0, "b")]), path).collect()
    assert sorted((r["doc_id"], r["start"]) for r in rows) == [(0, 0), (1, 2), (1, 4)]
