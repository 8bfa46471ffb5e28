import random
import re

import pytest

from bazarlens.llm.near_dedup import NearDuplicates, Sketcher, keep_one_each, near_duplicates
from tests.llm.support import clashing, documents
from tests.llm.test_components import plain_components

WORDS = [f"w{i}" for i in range(300)]


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def expected(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = plain_components(links)
    return {i: (len(sets[i]), found.get(i, i), found.get(i, i) == i) for i in ids}


def collected(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in frame.collect()}


def made_texts():
    random.seed(8)
    texts = []
    for _ in range(12):
        base = [random.choice(WORDS) for _ in range(random.randint(8, 120))]
        texts.append(" ".join(base))
        for _ in range(random.randint(0, 5)):
            base = list(base)
            for _ in range(random.randint(0, 3)):
                base[random.randrange(len(base))] = random.choice(WORDS)
            texts.append(" ".join(base))
    # A chain: each like the next, the ends unlike each other.
    chain = [f"c{i}" for i in range(60)]
    for i in range(0, 30, 3):
        texts.append(" ".join(chain[i : i + 40]))
    return texts + [None, "", " \t\n", "one", "One", "two words", "Two  Words", "Ä b", "ä b", "x " * 30000]


@pytest.mark.parametrize("width", [2, 5])
def test_equals_all_pairs(spark, width):
    rows = list(enumerate(made_texts()))
    random.Random(1).shuffle(rows)
    assert collected(near_duplicates(clashing(documents(spark, rows)), NearDuplicates(shingle_words=width))) == expected(rows, width)


def test_group_of_near_copies_with_unlike_members(spark):
    random.seed(2)
    base = [random.choice(WORDS) for _ in range(80)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(random.randint(0, 9)):
            words[random.randrange(80)] = f"n{random.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    assert collected(near_duplicates(documents(spark, rows), NearDuplicates(shingle_words=2))) == expected(rows, 2)


def test_rows_without_id_repeats_and_empty_table(spark):
    text = "a b c d e f g h"
    frame = near_duplicates(documents(spark, [(None, text), (5, text), (5, text), (3, text), (9, "other words here")]), NearDuplicates(shingle_words=2))
    rows = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["component_id"], r["kept"]) for r in frame.collect())
    assert rows == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]
    assert near_duplicates(documents(spark, [])).count() == 0


def test_near_copy_of_the_other_text_of_an_id(spark):
    """Twelve ids that each repeat with another text; each other text has one near copy of another id."""
    random.seed(12)
    rows, want = [], {}
    for i in range(12):
        first, second = ([f"r{i}x{j}q{random.randint(0, 9)}" for j in range(60)] for _ in range(2))
        near = list(second)
        near[random.randrange(60)] = "else"
        rows += [(i, " ".join(first)), (i, " ".join(second)), (100 + i, " ".join(near))]
        want |= {i: i, 100 + i: i}
    found = near_duplicates(documents(spark, rows), NearDuplicates(shingle_words=2)).collect()
    assert len(found) == 36 and {r["doc_id"]: r["component_id"] for r in found} == want


def test_keep_one_each_of_repeated_and_missing_ids(spark):
    """One row of a group stays, whatever its ids are; unlike texts of one id both stay."""
    text, near, other = " ".join(WORDS[:60]), " ".join([*WORDS[:59], "end"]), " ".join(WORDS[100:160])
    rows = [(7, text), (7, text), (None, text), (None, near), (5, near), (7, other), (None, " ".join(WORDS[200:240])), (None, " ".join(WORDS[200:240])), (None, None), (None, None), (8, ""), (8, "")]
    kept = keep_one_each(clashing(documents(spark, rows))).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted(
        [(5, near), (7, other), (None, " ".join(WORDS[200:240])), (None, None), (None, None), (8, ""), (8, "")], key=repr
    )


def test_keep_one_each_keeps_columns(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "g h i j k l", None])
    kept = keep_one_each(clashing(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]
    assert kept.columns == clashing(docs).columns


def test_odd_sketch_estimates_high_similarities():
    settings = NearDuplicates(shingle_words=2)
    sketcher = Sketcher(settings)
    random.seed(3)
    words = [f"v{i}" for i in range(500)]
    other = words[:470] + [f"u{i}" for i in range(30)]
    a, b = (sketcher.shingles(" ".join(x)) for x in (words, other))
    true = len(set(a) & set(b)) / len(set(a) | set(b))
    x, y = (sketcher.odd_sketch(sketcher.minhash(s)) for s in (a, b))
    differing = sum(int(v).bit_count() for v in (x ^ y).view("uint64"))
    bits = 64 * settings.sketch_words
    import math

    estimate = 1 + bits / 2 * math.log(1 - 2 * differing / bits) / (2 * settings.samples)
    assert abs(estimate - true) < 0.1
