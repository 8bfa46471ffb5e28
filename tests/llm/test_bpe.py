import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from bazarlens.llm import bpe
from tests.llm.support import clashing, documents


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.TextEncoder(ranks, public_tokenizers.PATTERN)


def odd_texts():
    random.seed(6)
    texts = ["", " ", "  a  b\n\n\tc ", "it's we'll 's\n 'x", " a b  c", "a  b  c", "aaaa" * 50, "日本語 テスト\U0001f642\U0001f642", "x" * 5000, " \n ", "a\nb", "\n", "\x00 \x01", "<|endoftext|>"]
    return texts + ["".join(random.choice(" \n\tab'sétion1,$ 日.") for _ in range(random.randint(0, 40))) for _ in range(400)]


def test_equals_the_library(encoder, library):
    texts = odd_texts()
    for text, values in zip(texts, encoder.cached().values(texts), strict=True):
        assert np.frombuffer(b"".join(values), np.int32).tolist() == library.encode_ordinary(text), repr(text)


def test_appends_and_edits(encoder, library):
    random.seed(7)
    for _ in range(40):
        data = "".join(random.choice(["tion", "the", " ", "é", "ing", "x", "日", "  "]) for _ in range(60)).encode()
        table = bpe.PrefixTable(encoder.vocabulary, data[:20])
        before = list(table.last)
        table.append(data[20:])
        assert table.last[:21] == before
        start = random.randint(0, len(data))
        stop = random.randint(start, min(len(data), start + 6))
        table.replace(start, stop, random.choice([b"", b"ab", b"tion"]))
        assert table.last == bpe.PrefixTable(encoder.vocabulary, table.data).last
        assert table.ids() == library._core_bpe.encode_single_piece(table.data)


def test_edit_near_the_start_leaves_the_end(encoder):
    table = bpe.PrefixTable(encoder.vocabulary, b"the nation of things " * 40)
    encoder.vocabulary.length.max()
    assert table.replace(3, 4, b"-") < len(table.data)


def test_documents(spark, ranks, library):
    texts = odd_texts()[:60] + [None, "word " * 20000]
    docs = clashing(documents(spark, [(None, "a"), (4, "b"), (4, "b"), *enumerate(texts, 10)]))
    rows = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    found = {r["doc_id"]: r for r in rows.collect()}
    assert rows.count() == len(texts) + 3
    for i, text in enumerate(texts, 10):
        ids = library.encode_ordinary(text or "")
        assert (list(found[i]["ids"]), found[i]["n_tokens"]) == (ids, len(ids))
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(rows, ranks).collect()}
    assert all(back[i] == (text or "") for i, text in enumerate(texts, 10))
    assert bpe.encode(documents(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_only_pairs_that_may_merge_are_searched_for(encoder, library, monkeypatch):
    """Pieces of all lengths side by side are encoded as by the library, and few of their pairs need the search."""
    random.seed(8)
    pieces = ["".join(random.choice("etaoinshré") for _ in range(random.choice((0, 1, 3, 9, 9, 40, 300)))) for _ in range(1500)]
    vocabulary, asked, searched = encoder.vocabulary, [], []
    follow, search = vocabulary.may_follow, np.searchsorted

    def counted(keys, values, *a, **b):
        if keys is vocabulary.pair_keys:
            searched.append(len(values))
        return search(keys, values, *a, **b)

    monkeypatch.setattr(vocabulary, "may_follow", lambda a, b: asked.append(len(a)) or follow(a, b))
    monkeypatch.setattr(np, "searchsorted", counted)
    found = vocabulary.encode([x.encode() for x in pieces])
    assert [np.frombuffer(x, np.int32).tolist() for x in found] == [library._encode_single_piece(x) if x else [] for x in pieces]
    assert 0 < sum(searched) < sum(asked)
