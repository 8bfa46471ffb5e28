import math
import random
import re

import numpy as np
import pytest

from bazarlens.llm.lexical_search import BlockSearch, Search, build_index, search, terms_of
from tests.llm.support import clashing, documents

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(rows, items, k):
    """{item: [(rank, doc_id, score)]} by scoring every document."""
    docs = [(i, plain_terms(t)) for i, t in rows]
    docs = [(i, t) for i, t in docs if t]
    n, length = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, terms in docs:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(plain_terms(text))
    result = []
    for item, terms in asked.items():
        scored = []
        for doc_id, words in docs:
            m = 50 + (50 * len(words) * n) // length
            score = 0
            for t in terms & set(words):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * words.count(t)) // (1000 * words.count(t) + 20 * m))
            if score > 0:
                scored.append((-score, math.inf if doc_id is None else doc_id, doc_id, score))
        scored.sort(key=lambda r: r[:2])
        result += [(item, rank, d, s) for rank, (_, _, d, s) in enumerate(scored[:k], 1)]
    return sorted(result, key=repr)


def made(n, seed):
    random.seed(seed)
    frequent, rare = [f"f{i}" for i in range(12)], [f"r{i}" for i in range(80)]
    rows = []
    for i in range(n):
        words = [random.choice(frequent) for _ in range(random.randint(0, 25))] + [random.choice(rare) for _ in range(random.randint(0, 4))]
        random.shuffle(words)
        rows.append((i, random.choice([" ", ", ", "-"]).join(words)))
    items = [(i, " ".join(random.sample(frequent, 7) + random.sample(rare, 3))) for i in range(9)]
    return rows, items


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def item_frame(spark, items):
    return clashing(spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("settings", [Search(), Search(k=5, block_docs=37, paired_terms=8, items_per_batch=4), Search(k=2, block_docs=11, block_words=90, paired_terms=1)])
def test_equals_scoring_all(spark, settings):
    rows, items = made(300, 3)
    # Equal documents (ties), no id, no text, no terms, one very long text.
    rows += [(900 - i, "f1 r3 r4") for i in range(60)] + [(None, "f1 r3 r4"), (400, None), (401, ""), (402, " -- \x00!"), (403, "R5 " * 40000 + "ümlaut r7"), (7, "f2 r9")]
    items += [(50, None), (51, ""), (52, "not-there"), (None, "f1"), (3, "r11 R12"), (53, "ÜMLAUT ümlaut f1, f1"), (54, "r5")]
    index = build_index(clashing(documents(spark, rows)), settings)
    assert collected(search(index, item_frame(spark, items), settings)) == plain_search(rows, items, settings.k)


def test_empty_tables(spark):
    index = build_index(documents(spark, []))
    assert search(index, item_frame(spark, [(1, "a b")])).count() == 0
    index = build_index(documents(spark, [None, "", "a b c"]))
    assert search(index, item_frame(spark, [])).count() == 0
    assert collected(search(index, item_frame(spark, [(1, "A")]))) == plain_search([(2, "a b c")], [(1, "A")], 50)


def test_terms():
    texts = ["a-B_céD 9ªx　y", "\x7f\x00", None, "naïve_x"]
    assert [[t.decode() for t in terms_of(x)] for x in texts] == [plain_terms(x) for x in texts]


def block_of(seed, n=4000):
    generator = np.random.default_rng(seed)
    lists, present = {}, {}
    for t in range(14):
        share, weight = (0.5, 60) if t < 10 else (0.02, 200)
        docs = np.flatnonzero(generator.random(n) < share)
        if t < 10 and t % 2:
            # Terms that hardly meet their neighbours, or only with small impacts.
            docs = np.setdiff1d(np.arange(0, n, 2), present[t - 1])
        present[t] = docs
        lists[t] = docs, generator.integers(1, weight, len(docs))
    pairs = {}
    for a in range(10):
        for b in range(a + 1, 10):
            both, i, j = np.intersect1d(lists[a][0], lists[b][0], return_indices=True)
            if len(both):
                flags = np.zeros(n, np.uint8)
                flags[both] = 1
                pairs[a, b] = int((lists[a][1][i] + lists[b][1][j]).max()), np.packbits(flags, bitorder="little")
    return lists, pairs


@pytest.mark.parametrize("seed", range(6))
def test_pair_bounds_open_fewer_lists(seed):
    """The same result as with single bounds and as adding everything up, from fewer postings."""
    n, k = 4000, 10
    lists, pairs = block_of(seed, n)
    ids = np.random.default_rng(seed).permutation(n)
    scores = np.zeros(n, np.int64)
    for docs, impacts in lists.values():
        scores[docs] += impacts
    order = np.lexsort((ids, -scores))[:k]
    paired = BlockSearch(n, lists, pairs, set(range(10)), ids, k)
    single = BlockSearch(n, lists, {}, set(), ids, k)
    for block in (paired, single):
        found, best = block.best(list(lists))
        assert found.tolist() == order.tolist() and best.tolist() == scores[order].tolist()
    assert paired.opened < single.opened <= sum(len(x[0]) for x in lists.values())


def test_bounds_hold_for_every_document():
    lists, pairs = block_of(1)
    block = BlockSearch(4000, lists, pairs, set(range(10)), np.arange(4000), 10)
    terms = sorted(lists, key=lambda t: (block.most[t], t))
    total = np.zeros(4000, np.int64)
    for term, (bound, paired, singles) in zip(terms, block.matchings(terms)[1:], strict=True):
        total[lists[term][0]] += lists[term][1]
        assert (total <= block.rest(paired, singles, np.arange(4000))).all() and total.max() <= bound
    assert bound < sum(block.most.values())
