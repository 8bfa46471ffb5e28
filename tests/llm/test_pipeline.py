import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from bazarlens.llm import bpe, decontaminate, near_dedup, pseudonyms, quality
from bazarlens.llm.common import read_table
from tests.llm.support import clashing, documents
from tests.llm.test_near_dedup import expected
from tests.llm.test_pseudonyms import luhn

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage returns over the smallest table and planted rows."""
    rng = random.Random(4)
    source = read_table(spark, SF, "documents")
    texts = [r["text"] for r in source.collect()]
    items = [r["text"] for r in read_table(spark, SF, "benchmark").collect()]
    words = " ".join(texts).split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    planted = [(100_000, base), (100_001, base), (100_002, base + " end"), (100_003, text(60) + " " + items[3] + " " + text(60)), (100_004, text(50) + " 93.81.200.107 " + text(5)), (100_005, None), (None, text(30))]
    docs = clashing(source.unionByName(documents(spark, planted)))
    made, folder = [docs], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, made[-1], SF).write.parquet(f"{folder}/{name}")
        made.append(spark.read.parquet(f"{folder}/{name}"))
    return made


def ids(frame):
    return {r["doc_id"] for r in frame.select("doc_id").collect()}


def test_stages_against_plain_rules(spark, stages):
    docs, good, single, clean, private, encoded = stages
    assert all(x.columns == docs.columns for x in (good, single, clean, private))
    model = quality.fit(docs, read_table(spark, SF, "labels"))
    scorer = quality.Scorer(model, quality.Settings())
    assert ids(good) == {r["doc_id"] for r in docs.collect() if scorer.scores([r["text"]])[0] >= 0.3}
    rows = [(r["doc_id"], r["text"]) for r in good.collect() if r["doc_id"] is not None]
    wanted = expected(rows, 5)
    assert ids(single) == {i for i, x in wanted.items() if x[2]} | {None}
    assert {100_001, 100_002}.isdisjoint(ids(single)) and 100_000 in ids(single)
    items = [" ".join(x.decode() for x in decontaminate.words_of(r["text"])) for r in read_table(spark, SF, "benchmark").collect()]
    joined = {r["doc_id"]: " ".join(x.decode() for x in decontaminate.words_of(r["text"])) for r in single.collect()}
    assert ids(clean) == {i for i, t in joined.items() if not any(x in t for x in items)} and 100_003 not in ids(clean)
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in (clean, private))
    assert before.keys() == after.keys() and "93.81.200.107" not in after[100_004]["text"]
    pattern = re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b|\+1 \(\d{3}\) \d{3}-\d{4}|[\w.]+@\w+\.example\.com")
    for i, r in before.items():
        if r["text"] is None:
            assert after[i]["text"] is None
            continue
        # Sixteen digits that fail the check are no card number and stay.
        found = [x for x in pattern.findall(r["text"]) if len(x) != 16 or not x.isdigit() or luhn(x)]
        assert not any(x in after[i]["text"] for x in found)
        assert found or after[i]["text"] == r["text"]
        assert after[i]["n_chars"] == len(after[i]["text"])
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in encoded.collect():
        text = after[r["doc_id"]]["text"] or ""
        assert list(r["ids"]) == library.encode_ordinary(text) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert ids(encoded) == ids(private)


def test_run_equals_the_stages(spark):
    docs = read_table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda x: sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in x.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)


def test_stages_over_no_rows(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_shared_parameters():
    assert near_dedup.NearDuplicates().shingle_words == 5 and near_dedup.NearDuplicates().percent == 80
    assert pseudonyms.ROUNDS % 2 == 0
