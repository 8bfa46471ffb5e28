import random
import re

import numpy as np
import pytest

from bazarlens.llm.parity_join import ParityJoin, ParitySketcher, hamming, similar_documents
from tests.llm.support import clashing, documents
from tests.llm.test_components import plain_components

WORDS = [f"w{i}" for i in range(400)]


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def expected(rows, width=4, percent=85):
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for a in ids for b in ids
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    found = plain_components(links)
    return {i: (len(sets[i]), found.get(i, i)) for i in ids}


def collected(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


def made_texts(seed=5):
    random.seed(seed)
    texts = []
    for _ in range(25):
        base = [random.choice(WORDS) for _ in range(random.choice([4, 5, 7, 9, 14, 40, 90, 300]))]
        texts.append(" ".join(base))
        for _ in range(random.randint(0, 5)):
            near = list(base)
            # About as many changes as the threshold allows, at the ends as well as inside.
            for _ in range(random.randint(0, 1 + len(base) // 50)):
                near[random.choice([0, -1, random.randrange(len(near))])] = random.choice(WORDS)
            texts.append(" ".join(near[random.randint(0, len(near) // 15) :]))
    chain = [f"c{i}" for i in range(140)]
    texts += [" ".join(chain[i : i + 80]) for i in range(0, 60, 5)]
    return texts + [None, "", " \t\n", "one", "One", "three short words", "Three  Short Words", "Ä b c d", "ä b c d", "x " * 30000, "a b c d e"]


def test_equals_all_pairs(spark):
    rows = list(enumerate(made_texts()))
    random.Random(1).shuffle(rows)
    assert collected(similar_documents(clashing(documents(spark, rows)))) == expected(rows)


@pytest.mark.parametrize("percent", [60, 95])
def test_other_thresholds(spark, percent):
    rows = list(enumerate(made_texts(9)))
    settings = ParityJoin(shingle_words=2, percent=percent)
    assert collected(similar_documents(documents(spark, rows), settings)) == expected(rows, 2, percent)


def test_large_group_with_unlike_members(spark, monkeypatch):
    """Many groups of outsiders and members under one centre, in bounded pieces."""
    import bazarlens.llm.parity_join as module

    monkeypatch.setattr(module, "OUTSIDERS_PER_GROUP", 7)
    monkeypatch.setattr(module, "MEMBERS_PER_GROUP", 11)
    monkeypatch.setattr(module, "SALTS", 3)
    random.seed(2)
    base = [random.choice(WORDS) for _ in range(100)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(random.randint(0, 5)):
            words[random.randrange(100)] = f"n{random.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    got = collected(similar_documents(documents(spark, rows)))
    assert got == expected(rows)
    assert 1 < len({c for _, c in got.values()}) < 90


def test_rows_without_id_repeats_and_empty_table(spark):
    text, near = " ".join(WORDS[:60]), " ".join(WORDS[:59] + ["end"])
    rows = [(None, text), (5, text), (5, text), (3, near), (5, "other words in this text"), (9, "Other words in this text"), (None, "no one like it"), (None, None), (7, None)]
    found = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in similar_documents(documents(spark, rows)).collect()), key=repr)
    assert found == sorted(
        [(-1, 57, 3), (5, 57, 3), (5, 57, 3), (3, 57, 3), (5, 2, 5), (9, 2, 5), (-1, 1, None), (-1, 0, None), (7, 0, 7)], key=repr
    )
    empty = similar_documents(documents(spark, []))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0


def test_no_similar_pair_misses_a_common_word():
    """The pigeonhole: every pair at the threshold has a key in common, and a Hamming distance within its bound."""
    settings = ParityJoin()
    sketcher = ParitySketcher(settings)
    generator = np.random.default_rng(4)
    for _ in range(1500):
        n = int(generator.integers(1, 700))
        union = generator.integers(0, 1 << 63, n, dtype=np.uint64)
        gone = int(generator.integers(0, n * 15 // 100 + 1))
        cut = int(generator.integers(0, gone + 1))
        a, b = np.sort(union[cut:]), np.sort(np.concatenate([union[:cut], union[gone:]]))
        if not len(a) or not len(b) or np.array_equal(a, b):
            continue
        assert 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
        assert set(sketcher.keys(a)) & set(sketcher.keys(b))
        words = min(settings.sketch_words(len(a)), settings.sketch_words(len(b)))
        apart = np.bitwise_count(sketcher.sketch(a, words) ^ sketcher.sketch(b, words)).sum()
        assert apart <= len(np.setxor1d(a, b)) <= settings.difference(len(a) + len(b))


def test_folded_distance_in_columns(spark):
    sketcher = ParitySketcher(ParityJoin())
    generator = np.random.default_rng(6)
    a, b = (np.sort(generator.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (120, 140))
    assert (len(sketcher.sketch(a)), len(sketcher.sketch(b))) == (2, 4)
    frame = spark.createDataFrame([tuple(sketcher.sketch(x).view(np.int64).tolist() for x in (a, b))], "a array<long>, b array<long>")
    want = int(np.bitwise_count(sketcher.sketch(a) ^ sketcher.sketch(b, 2)).sum())
    assert frame.select(hamming(frame["a"], frame["b"]), hamming(frame["b"], frame["a"])).first() == (want, want)
