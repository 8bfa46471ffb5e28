import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazarlens.llm import quality, toxicity
from bazarlens.llm.common import is_held_out
from bazarlens.llm.subwords import subword_hashes
from tests.llm.support import clashing, documents


def held_out(number):
    return zlib.crc32(str(number).encode()) % 5 == 0


def label_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    syllables = "ka lo mi ne ru sta tri von pel gar dus im".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    bad = ["vilux", "drogat", "smerp", "fnord"]
    rows, labels = [], []
    for i in range(1500):
        words = [word() for _ in range(rng.randint(10, 120))]
        toxic, junk = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "en", "."]))
        if junk:
            kind = rng.randrange(3)
            words = [w + "$$$" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w for w in words for _ in range(8)]
        rows.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_held_out_rows_are_the_crc_fifth(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id")).withColumn("h", is_held_out()).collect()
    assert all(r["h"] == held_out(r["doc_id"]) for r in rows)


def accuracy(frame, labels, place):
    truth = {x[0]: x[place] for x in labels}
    rows = [r for r in frame.collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    return sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows)


def test_toxicity_held_out(spark, corpus):
    rows, labels = corpus
    docs, marks = clashing(documents(spark, rows)), label_frame(spark, labels)
    model = toxicity.fit(docs, marks)
    assert accuracy(toxicity.score_texts(docs, model), labels, 2) >= 0.95
    # Held-out labels and the labels of other texts are no input.
    turned = label_frame(spark, [(i, q, 1 - t if held_out(i) else t) for i, q, t in labels])
    other = toxicity.fit(docs, turned)
    assert (other.buckets == model.buckets).all() and (other.weights == model.weights).all() and other.bias == model.bias


def test_quality_held_out(spark, corpus):
    rows, labels = corpus
    docs, marks = clashing(documents(spark, rows)), label_frame(spark, labels)
    model = quality.fit(docs, marks)
    assert accuracy(quality.score_texts(docs, model), labels, 1) >= 0.95
    turned = label_frame(spark, [(i, 1 - q if held_out(i) else q, t) for i, q, t in labels])
    assert (quality.fit(docs, turned).weights == model.weights).all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, corpus, module):
    rows, labels = corpus
    model = module.fit(documents(spark, rows[:400]), label_frame(spark, labels + [(None, 1, 1), (1, None, None), labels[0]]))
    docs = documents(spark, [(None, "a"), (3, None), (3, ""), (4, " \n"), (5, "word " * 50_000), (5, "word " * 50_000)])
    found = module.score_texts(docs, model).collect()
    assert len(found) == 6 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)
    blank = {r["score"] for r in found if r["doc_id"] in (3, 4)}
    assert len(blank) == 1 and [r["held_out"] for r in found if r["doc_id"] is None] == [True]
    assert module.score_texts(documents(spark, []), model).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels_or_with_one_class(spark, module):
    docs = documents(spark, [f"some text {i}" for i in range(30)])
    for labels in ([], [(i, 1, 0) for i in range(30)]):
        rows = module.score_texts(docs, module.fit(docs, label_frame(spark, labels))).collect()
        assert len(rows) == 30
        if module is toxicity:
            assert not any(r["predicted"] for r in rows)
    empty = documents(spark, [])
    assert module.score_texts(docs, module.fit(empty, label_frame(spark, [(1, 0, 1), (2, 1, 0), (3, 1, 1)]))).count() == 30


def test_keep_good_keeps_columns(spark, corpus):
    rows, labels = corpus
    docs = clashing(documents(spark, rows))
    model = quality.fit(docs, label_frame(spark, labels))
    kept = quality.keep_good(docs, model)
    good = {r["doc_id"] for r in quality.score_texts(docs, model).collect() if r["predicted"] == 1}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == good


def test_negative_risk_is_raised_again():
    from bazarlens.llm.toxicity import Settings, _fit

    # All unlabelled texts look like the positives; without the correction every text would end up toxic or the loss below zero.
    positive = [np.array([1, 2], np.int32)] * 50
    unlabelled = [np.array([3], np.int32)] * 100 + [np.array([1, 2], np.int32)] * 20
    model = _fit(positive, unlabelled, 0.3, Settings())
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    assert weights[1] > 0 and model.bias < 0 and model.bias + weights[1] + weights[2] > 0


def test_chosen_id_that_repeats_very_often(spark):
    """A bounded sample stays so: of a repeated id one text is learnt from."""
    texts = [(i, f"plain words number{i} here") for i in range(40)] + [(40 + i, f"vilux smerp number{i}") for i in range(10)]
    labels = label_frame(spark, [(i, int(i < 25), int(i >= 40)) for i in range(50)])
    often = [(i, t) for i, t in texts if i not in (41, 42)] + [(41, "vilux other"), (42, "vilux more")] + [(41, "vilux zzz")] * 3000 + [(42, "vilux zzz")] * 3000
    for module, name in ((toxicity, "_fit"), (quality, "_fit")):
        seen = []
        original = getattr(module, name)
        try:
            setattr(module, name, lambda *a: seen.append(a) or original(*a))
            module.fit(documents(spark, often).repartition(7), labels)
        finally:
            setattr(module, name, original)
        assert len(seen[0][0]) <= 50


def plain_risk_fit(positive, unlabelled, prior, s):
    """The selection of features and the corrected risk in plain loops: {bucket: weight}, bias."""
    n_p, n_u = len(positive), len(unlabelled)
    distance = {}
    for b in sorted({int(b) for t in positive + unlabelled for b in t}):
        in_p, in_u = sum(b in t for t in positive), sum(b in t for t in unlabelled)
        share_p, share_u = in_p / n_p, in_u / n_u
        share_n = min(1.0, max(0.0, (share_u - prior * share_p) / (1 - prior)))
        usual = max(share_u, 1 / n_u)
        spread = math.sqrt(usual * (1 - min(usual, 0.99)) * (1 / n_p + 1 / n_u))
        if in_p >= max(s.least_texts, 0.01 * n_p) and (share_p - share_n) / spread > s.least_distance:
            distance[b] = (share_p - share_n) / spread
    buckets = sorted(sorted(distance, key=lambda b: (-distance[b], b))[: s.features])
    w, bias = dict.fromkeys(buckets, 0.0), math.log(prior / (1 - prior))
    m, v = dict.fromkeys([*buckets, "bias"], 0.0), dict.fromkeys([*buckets, "bias"], 0.0)
    chance = lambda t: 1 / (1 + math.exp(-(bias + sum(w[b] for b in t if b in w))))
    for step in range(1, s.epochs + 1):
        p, u = [chance(t) for t in positive], [chance(t) for t in unlabelled]
        harmless = sum(-math.log(1 - x) for x in u) / n_u - prior * sum(-math.log(1 - x) for x in p) / n_p
        g = {b: s.decay * w[b] for b in buckets} | {"bias": 0.0}

        def push(text, slope):
            g["bias"] += slope
            for b in text:
                if b in w:
                    g[b] += slope

        for t, x in zip(positive, p):
            # d/ds of -log(chance) and of -log(1 - chance).
            push(t, (prior * (x - 1) - prior * x) / n_p if harmless >= 0 else prior * x / n_p)
        for t, x in zip(unlabelled, u):
            push(t, x / n_u if harmless >= 0 else -x / n_u)
        for k in g:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            move = s.rate * (m[k] / (1 - 0.9**step)) / (math.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            if k == "bias":
                bias -= move
            else:
                w[k] -= move
    return w, bias


@pytest.mark.parametrize("prior, epochs", [(0.1, 1), (0.1, 6), (0.6, 8)])
def test_corrected_risk_against_plain_loops(prior, epochs):
    """A high prior drives the harmless part of the risk below zero, where it is raised again."""
    rng = np.random.default_rng(int(prior * 10) + epochs)
    positive = [np.unique(rng.choice([1, 2, 3, 4, *range(20, 60)], 9, p=[0.15] * 4 + [0.01] * 40)).astype(np.int32) for _ in range(40)]
    unlabelled = [np.unique(rng.integers(20, 60, 6)).astype(np.int32) for _ in range(70)] + positive[:10]
    settings = toxicity.Settings(bucket_bits=6, least_distance=2.0, epochs=epochs)
    model = toxicity._fit(positive, unlabelled, prior, settings)
    weights, bias = plain_risk_fit(positive, unlabelled, prior, settings)
    assert model.buckets.tolist() == sorted(weights) and len(weights) >= 3
    assert model.weights.tolist() == pytest.approx([weights[b] for b in sorted(weights)], rel=1e-6)
    assert model.bias == pytest.approx(bias, rel=1e-6)


def plain_softmax_fit(samples, s):
    """Averaged feature vectors and softmax regression in plain loops, one text a step."""
    size = (1 << s.bucket_bits) + 1
    generator = np.random.default_rng(s.seed)
    vectors = (generator.uniform(-1, 1, (size, s.dims)).astype(np.float32) / s.dims).astype(float).tolist()
    output, bias = [[0.0, 0.0] for _ in range(s.dims)], [0.0, 0.0]
    done, total = 0, s.epochs * len(samples)
    for _ in range(s.epochs):
        for i in generator.permutation(len(samples)):
            text, y = samples[i]
            words = text.split()
            share: dict[int, float] = {}
            for word in words:
                marked = b"<" + word + b">"
                _, hashes = subword_hashes([word], s.sizes)
                assert len(hashes) == 1 + sum(max(0, len(marked) - n + 1) for n in s.sizes)
                for h in hashes:
                    bucket = int(h) >> (32 - s.bucket_bits)
                    share[bucket] = share.get(bucket, 0.0) + 1 / len(words) / len(hashes)
            share[size - 1] = sum(a == b for a, b in zip(words, words[1:])) / len(words)
            hidden = [sum(x * vectors[b][d] for b, x in share.items()) for d in range(s.dims)]
            logits = [sum(hidden[d] * output[d][c] for d in range(s.dims)) + bias[c] for c in (0, 1)]
            top = max(logits)
            chance = [math.exp(x - top) for x in logits]
            chance = [x / sum(chance) for x in chance]
            error = [chance[c] - (c == y) for c in (0, 1)]
            rate = s.rate * (1 - done / total)
            done += 1
            back = [sum(output[d][c] * error[c] for c in (0, 1)) for d in range(s.dims)]
            for d in range(s.dims):
                for c in (0, 1):
                    output[d][c] -= rate * hidden[d] * error[c]
            for c in (0, 1):
                bias[c] -= rate * 0.1 * error[c]
            for b, x in share.items():
                for d in range(s.dims):
                    vectors[b][d] -= rate * x * back[d]
    weights = [sum(row[d] * (output[d][1] - output[d][0]) for d in range(s.dims)) for row in vectors]
    return weights, bias[1] - bias[0]


def test_softmax_fit_against_plain_loops():
    rng = random.Random(5)
    words = ["alpha", "be", "gamma", "délta", "x"]
    texts = [(" ".join(rng.choice(words[:3] if i % 2 else words[2:]) for _ in range(rng.randint(1, 12))).encode(), i % 2) for i in range(12)]
    settings = quality.Settings(bucket_bits=5, dims=4, epochs=2)
    model = quality._fit([(*quality._counted(t.decode()), y) for t, y in texts], settings)
    weights, bias = plain_softmax_fit(texts, settings)
    assert model.bias == pytest.approx(bias, abs=1e-4)
    assert model.weights.tolist() == pytest.approx(weights, abs=1e-4)
