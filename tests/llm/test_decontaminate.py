import random

import numpy as np
import pytest

from bazarlens.llm import decontaminate
from bazarlens.llm.decontaminate import Settings, contaminated, without_contaminated, words_of
from tests.llm.support import clashing, documents

WORDS = [f"word{i}" for i in range(3000)]
COMMON = "the of and to in is that it for on with as at by".split()


def sentence(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def items():
    rng = random.Random(5)
    return [(i, sentence(rng, rng.randint(15, 60)) + ".") for i in range(60)] + [(900, sentence(rng, 300))]


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_subsequence_equals_the_table_method():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randint(0, 5) for _ in range(rng.randint(1, 40))]
        b = [x for x in (rng.randint(0, 7) for _ in range(rng.randint(0, 60))) if x in a]
        masks = [sum(1 << i for i, y in enumerate(a) if y == x) for x in range(8)]
        assert decontaminate.common_subsequence(masks, len(a), b) == plain_lcs(a, b)


def test_copies_and_paraphrases_are_found_clean_texts_are_not(spark, items):
    rng = random.Random(2)
    rows, wanted = [], set()
    for n, (item, text) in enumerate(items):
        rows.append((2 * n, f"{sentence(rng, 90)} {text.upper()} {sentence(rng, 70)}"))
        wanted.add((2 * n, item))
        words = text.split()
        changed = [rng.choice(WORDS) if rng.random() < 0.1 else w for w in words if rng.random() > 0.05]
        rows.append((2 * n + 1, f"{sentence(rng, 30)} {' '.join(changed)} {sentence(rng, 200)}"))
        wanted.add((2 * n + 1, item))
    rows += [(1000 + i, sentence(rng, rng.randint(1, 400))) for i in range(200)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, sentence(rng, 30_000) + " " + items[7][1])]
    wanted.add((2003, 7))
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(clashing(documents(spark, rows)), bench(spark, items)).collect()}
    assert found <= wanted
    assert {x for x in wanted if x[0] % 2 == 0} <= found and len(found) >= 0.95 * len(wanted)


def test_blocks_give_the_same_and_rows_are_kept(spark, items):
    rng = random.Random(3)
    rows = [(i, f"{sentence(rng, 40)} {items[i][1]}" if i < 20 else sentence(rng, 50)) for i in range(40)] + [(None, items[0][1]), (7, "x"), (50, None)]
    docs = clashing(documents(spark, rows))
    whole = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench(spark, items)).collect()}
    small = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench(spark, items), Settings(block=20)).collect()}
    assert whole == small == {(i, i) for i in range(20)} | {(None, 0)}
    kept = without_contaminated(docs, bench(spark, items))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] is None) for r in kept.collect()) == sorted([(i, False) for i in range(20, 40)] + [(7, False), (50, True)])


def test_empty_tables_and_unusable_items(spark, items):
    docs = documents(spark, ["a b c d e f g h", None])
    for rows in ([], [(None, "a b c d e f g h"), (1, None), (2, ""), (3, "a b")]):
        assert contaminated(docs, bench(spark, rows)).count() == 0
        assert without_contaminated(docs, bench(spark, rows)).count() == 2
    assert contaminated(documents(spark, []), bench(spark, items)).count() == 0
    assert [r["item_id"] for r in contaminated(docs, bench(spark, [(4, "a b c d e f g h"), (4, "a b c d e f g h")])).collect()] == [4]


def test_svd_finds_the_strongest_directions(spark):
    rng = np.random.default_rng(2)
    matrix = rng.standard_normal((80, 6)) @ np.diag([9, 7, 5, 3, 0.1, 0.1]) @ rng.standard_normal((6, 50))
    rows = spark.createDataFrame([(list(range(50)), [float(x) for x in r]) for r in matrix], "places array<int>, weights array<double>")
    found = decontaminate.randomised_svd(rows, 50, Settings(rank=4, oversample=6))
    assert abs(np.linalg.norm(matrix @ found) - np.linalg.norm(np.linalg.svd(matrix)[1][:4])) < 1e-3 * np.linalg.norm(matrix)
    assert np.allclose(found.T @ found, np.eye(4), atol=1e-8)


def test_test_table_copies_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    texts = [(r["item_id"], " ".join(x.decode() for x in words_of(r["text"]))) for r in items.collect()]
    wanted = set()
    for r in docs.collect():
        text = " " + " ".join(x.decode() for x in words_of(r["text"])) + " "
        wanted.update((r["doc_id"], i) for i, t in texts if f" {t} " in text)
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()}
    assert wanted <= found and len(found) <= 1.1 * len(wanted) + 2


def test_verbatim_copies_are_found_whatever_the_size_of_the_benchmark(spark):
    rng = random.Random(11)
    items = [(i, sentence(rng, rng.randint(16, 59))) for i in range(1000)]
    rows = [(i, f"{sentence(rng, rng.randint(0, 60))} {text} {sentence(rng, rng.randint(0, 60))}") for i, text in items[::4]]
    rows += [(5000 + i, sentence(rng, 100)) for i in range(100)]
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(documents(spark, rows), bench(spark, items)).collect()}
    assert found == {(i, i) for i, _ in items[::4]}


def test_short_items_are_found_as_they_are(spark):
    rng = random.Random(12)
    items = [(i, " ".join(rng.sample(WORDS[:400], 1 + i % 2) + rng.sample(COMMON, 2 + i % 8))) for i in range(200)]
    rows = [(i, f"{sentence(rng, rng.randint(0, 60))} {text} {sentence(rng, rng.randint(0, 60))}") for i, text in items]
    rows += [(900, " ".join(reversed(items[0][1].split()))), (901, None)]
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(documents(spark, rows), bench(spark, items)).collect()}
    assert {(i, i) for i, _ in items} <= found and (900, 0) not in found
    only = bench(spark, [(1, "word1 of word2")])
    docs = documents(spark, ["see word1 of, word2", "word1 of the word2", "word2 of word1", "word1 of"])
    assert [(r["doc_id"], r["lcs_share"]) for r in contaminated(docs, only).collect()] == [(0, 1.0)]
