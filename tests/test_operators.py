"""Operators against pandas / brute force on small fixtures, with hot keys."""

import itertools
import json
import math
from collections import Counter
from datetime import datetime

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bazarlens import fixed_values
from bazarlens.functions import scalars
from bazarlens.operators import catalog, cluster, complaints, context, feedback, geo, ngrams, profiling, recommend, reviews, rfm, sales
from bazarlens.plans import questions
from bazarlens.plans.registry import QUERIES
from bazarlens.sources import documents, proxies, tables
from bazarlens.session import fresh_path


@pytest.fixture(scope="module")
def shop(spark):
    """A small shop: one order with three items, an order without items, an
    unknown product, a product without category, one without translation."""
    orders = spark.sql(
        """SELECT * FROM VALUES
        ('o1', 'c1', 'delivered', TIMESTAMP_NTZ'2018-08-28 16:00:00'),
        ('o2', 'c2', 'delivered', TIMESTAMP_NTZ'2018-08-01 10:00:00'),
        ('o3', 'c3', 'shipped',   TIMESTAMP_NTZ'2018-09-20 10:00:00'),
        ('o4', 'c4', 'delivered', TIMESTAMP_NTZ'2018-08-29 15:00:00'),
        ('o5', 'c1', 'delivered', TIMESTAMP_NTZ'2018-07-01 00:00:00')
        AS t(order_id, customer_id, order_status, order_purchase_timestamp)"""
    )
    items = spark.createDataFrame(
        [
            ("o1", "p1", 10.0, 1.0), ("o1", "p1", 10.0, 1.0), ("o1", "p2", 5.0, 1.0),
            ("o2", "p3", 7.5, 1.0), ("o2", "p9", 99.0, 1.0), ("o3", "p1", 10.0, 1.0), ("o5", "p4", 2.0, 1.0),
        ],
        "order_id string, product_id string, price double, freight_value double",
    )
    products = spark.createDataFrame(
        [("p1", "beleza"), ("p2", "beleza"), ("p3", "sem_traducao"), ("p4", None)], "product_id string, product_category_name string"
    )
    translation = spark.createDataFrame([("beleza", "beauty")], "product_category_name string, product_category_name_english string")
    reviews_ = spark.createDataFrame(
        [("r1", "o1", 1, "Não recebi"), ("r2", "o2", 2, None), ("r3", "o2", 5, "bom"), ("r4", "o5", 2, "veio errado")],
        "review_id string, order_id string, review_score int, review_comment_message string",
    )
    customers = spark.createDataFrame(
        [("c1", "u1", "santos", "SP", 1), ("c2", "u1", "santos", "SP", 1), ("c3", "u3", "rio", "RJ", 2), ("c4", "u4", "santos", "BA", 3)],
        "customer_id string, customer_unique_id string, customer_city string, customer_state string, customer_zip_code_prefix int",
    )
    geolocation = spark.createDataFrame(
        [(1, -23.0, -46.0), (1, -24.0, -46.5), (2, -22.0, -43.0), (3, 40.0, -46.0)],
        "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double",
    )
    return tables.Marketplace(orders, items, products, translation, reviews_, customers, geolocation)


def as_dict(frame, key, value):
    return {r[key]: r[value] for r in frame.collect()}


# --- sales -------------------------------------------------------------------------


def test_category_totals_follow_the_join_rules(shop):
    totals = sales.category_sales(shop.orders, shop.items, shop.products, shop.translation)
    assert as_dict(totals, "categoria", "units") == {"beauty": 3, "sem_traducao": 1, "unknown_category": 1}
    assert as_dict(totals, "categoria", "revenue") == {"beauty": 25.0, "sem_traducao": 7.5, "unknown_category": 2.0}


def test_equal_totals_are_ordered_by_name(spark):
    frame = spark.createDataFrame([("b", 1, 1.0), ("a", 1, 1.0), ("c", 2, 0.5)], "categoria string, units long, revenue double")
    assert [r[0] for r in sales.top_categories_by_units(frame, 2).collect()] == ["c", "a"]


# --- complaints ----------------------------------------------------------------------


def test_review_counts_once_per_item(shop):
    classified = complaints.classify_by_signals(reviews.filter_bad_reviews(shop.reviews))
    assert as_dict(classified, "review_id", "pain_point_category") == {
        "r1": "Logistica_Retrasos",
        "r4": "Producto_Incorrecto_Faltante",
    }
    counts = reviews.category_pain_counts(shop.reviews, classified, shop.items, shop.products, shop.translation)
    rates = {r["categoria"]: (r["total_resenas"], r["resenas_negativas"]) for r in reviews.join_rate(counts).collect()}
    # o2: two reviews x items p3 and p9 (an unknown product); r2 has no text.
    assert rates == {"beauty": (3, 3), "sem_traducao": (2, 0), "unknown_category": (3, 1)}
    rows = reviews.review_items(shop.reviews, shop.items, shop.products, shop.translation)
    assert rows.count() == 8


def test_rate_ranking_uses_the_rounded_rate(spark):
    counts = spark.createDataFrame(
        [("b", None, 1000), ("b", "Otro", 100), ("a", None, 1000), ("a", "Otro", 100), ("c", None, 10_000), ("c", "Otro", 1003), ("d", None, 5)],
        "categoria string, pain string, n long",
    )
    ranked = reviews.dissatisfaction_rate(counts, 100)
    assert [r["categoria"] for r in ranked.collect()] == ["a", "b", "c"]
    assert reviews.eligible_counts(counts, 100).first().asDict() == {"n_eligible": 3, "n_total": 4}


def test_shares(spark):
    frame = spark.createDataFrame([("Logistica_Retrasos",)] * 5 + [("Producto_Incorrecto_Faltante",)] * 3 + [("Otro",)] * 2, "pain_point_category string")
    assert sum(r["pct"] for r in reviews.pain_distribution(frame).collect()) == pytest.approx(100)
    row = reviews.combined_share(frame).first()
    assert (row["pct_1"], row["pct_2"], row["pct_combined"]) == (50.0, 30.0, 80.0)


def test_resume_classifies_each_review_once(spark, shop):
    path = fresh_path(spark, "resume")
    corpus = reviews.filter_bad_reviews(shop.reviews)
    calls = []

    def classifier(frame):
        calls.append([r[0] for r in frame.select("review_id").collect()])
        return complaints.classify_by_signals(frame)

    complaints.classify_resume(corpus.filter("review_id = 'r1'"), path, classifier)
    complaints.classify_resume(corpus, path, classifier)
    final = complaints.classify_resume(corpus, path, classifier)
    assert calls == [["r1"], ["r4"], []]
    assert sorted(r["review_id"] for r in final.collect()) == ["r1", "r4"]


def test_plugged_model_answers_are_parsed(spark, shop):
    def answer(prompts):
        return prompts.map(lambda p: "  logistica_retrasos!" if "recebi" in p else "no idea")

    got = as_dict(complaints.classify_with(reviews.filter_bad_reviews(shop.reviews), answer), "review_id", "pain_point_category")
    assert got == {"r1": "Logistica_Retrasos", "r4": "Otro"}


def test_ngrams_against_counter(spark):
    rng = np.random.default_rng(1)
    # One word makes up a third of all words.
    docs = [[("hot" if rng.random() < 0.34 else f"w{rng.integers(30)}") for _ in range(rng.integers(0, 60))] for _ in range(200)]
    frame = spark.createDataFrame([(d,) for d in docs], "tokens array<string>")
    freq, doc_freq = Counter(), Counter()
    for d in docs:
        for n in (1, 2, 3):
            grams = [(n, " ".join(d[i : i + n])) for i in range(len(d) - n + 1)]
            freq.update(grams)
            doc_freq.update(set(grams))
    want = {g: (freq[g], doc_freq[g]) for g in freq if doc_freq[g] >= 3}
    counts = ngrams.ngram_counts(frame)
    got = {(r["n"], r["term"]): (r["freq"], r["doc_freq"]) for r in counts.collect()}
    assert got == want
    # Few slots let more through, never less; sizes may be any; without a floor nothing is pruned.
    for sizes, min_df, slots in [((1, 2, 3), 3, 64), ((2,), 3, 1 << 12), ((3, 1), 5, 1 << 24), ((1, 2), 1, 64)]:
        some = ngrams.ngram_counts(frame, sizes=sizes, min_df=min_df, slots=slots)
        assert {(r["n"], r["term"]): (r["freq"], r["doc_freq"]) for r in some.collect()} == {
            g: (freq[g], doc_freq[g]) for g in freq if g[0] in sizes and doc_freq[g] >= min_df
        }
    best = ngrams.vocab_limit(counts, sizes=(1,), max_features=5).collect()
    order = sorted((g for g in want if g[0] == 1), key=lambda g: (-want[g][0], g[1]))[:5]
    assert {(r["n"], r["term"]) for r in best} == set(order)


def test_ngrams_of_empty_and_null_texts(spark):
    frame = spark.createDataFrame([(None,), ([],), (["a"],), (["a", "b"],), (["a", "b"],), (["x", "a", "b", "a", "b"],)], "tokens array<string>")
    got = {(r["n"], r["term"]): (r["freq"], r["doc_freq"]) for r in ngrams.ngram_counts(frame.repartition(3)).collect()}
    assert got == {(1, "a"): (5, 4), (1, "b"): (4, 3), (2, "a b"): (4, 3)}
    assert ngrams.ngram_counts(frame.limit(0)).count() == 0


def test_pruning_leaves_what_may_be_frequent():
    """Places of the n-grams whose parts pass, against plain loops, over several texts in one batch."""
    rng = np.random.default_rng(3)
    texts = [[int(x) for x in rng.integers(1, 9, rng.integers(0, 12))] for _ in range(40)] + [None, []]
    levels = ngrams._Levels(pa.array(texts, pa.list_(pa.int64())), 1 << 10)
    allowed = set(range(1, 7))
    bits = np.zeros(16, np.uint64)
    for word in allowed:
        bits[word >> 6] |= np.uint64(1 << (word & 63))
    levels.keep(bits)
    for n in (1, 2, 3):
        want = [[i + 1 for i in range(len(t or []) - n + 1) if set(t[i : i + n]) <= allowed] for t in texts]
        assert levels.places().to_pylist() == want
        levels.widen()


def test_ngrams_run_no_job_of_their_own_and_send_no_rows_per_occurrence(spark):
    frame = spark.createDataFrame([([f"w{i % 7}" for i in range(d, d + 60)],) for d in range(50)], "tokens array<string>").coalesce(1)
    spark.sparkContext.setJobGroup("ngrams-built", "")
    try:
        counts = ngrams.ngram_counts(frame, slots=4)
        # Nothing is counted beforehand, for the driver to send to all tasks.
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("ngrams-built")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r["n"], r["freq"], r["doc_freq"]) for r in counts.collect()} <= {(n, f, 50) for n in (1, 2, 3) for f in range(400, 440)}
    assert counts.count() == 21


def test_ngrams_of_tokens_with_blanks_and_nulls(spark):
    """Different tokens may make one term; it counts once a document."""
    docs = [["a b", "c"], ["a", "b c"], ["a b", "c", "a", "b c"], [None, "a", None], ["a", None, "a"], [None] * 4, ["", "a", ""], None, []] * 2
    term = lambda words: " ".join(w for w in words if w is not None)
    freq, doc_freq = Counter(), Counter()
    for d in docs:
        grams = [(n, term(d[i : i + n])) for n in (1, 2, 3) for i in range(len(d or []) - n + 1)]
        freq.update(grams)
        doc_freq.update(set(grams))
    frame = spark.createDataFrame([(d,) for d in docs], "tokens array<string>")
    got = {(r["n"], r["term"]): (r["freq"], r["doc_freq"]) for r in ngrams.ngram_counts(frame, min_df=2).collect()}
    assert got == {g: (freq[g], doc_freq[g]) for g in freq if doc_freq[g] >= 2}


def test_ngrams_are_packed_once_per_chunk_of_texts(monkeypatch):
    rng = np.random.default_rng(5)
    docs = [[f"w{rng.integers(12)}" for _ in range(rng.integers(0, 40))] for _ in range(60)] + [None, [], ["w1"] * 300]
    monkeypatch.setattr(ngrams, "CHUNK_TOKENS", 200)
    chunks = list(ngrams._chunks(pa.array(docs, pa.list_(pa.string()))))
    assert sum((c.to_pylist() for c in chunks), []) == docs and len(chunks) > 5
    assert all(len(c) == 1 or sum(map(len, filter(None, c.to_pylist()))) <= 200 for c in chunks)
    for chunk in chunks:
        freq, doc_freq = Counter(), Counter()
        for d in chunk.to_pylist():
            grams = [(n, " ".join(d[i : i + n])) for n in (1, 2, 3) for i in range(len(d) - n + 1)] if d else []
            freq.update(grams)
            doc_freq.update(set(grams))
        got = [(r["n"], t, f, c) for b in ngrams._counted(chunk, (1, 2, 3), 16) for r in b.to_pylist() for t, f, c in zip(r["terms"], r["freq"], r["docs"])]
        assert sorted(got) == sorted((n, t, freq[n, t], doc_freq[n, t]) for n, t in freq)


def test_functions_over_columns_and_groups(spark):
    frame = spark.createDataFrame([("a", 3, "X"), ("a", 5, None), ("b", None, "y")], "k string, n int, t string")
    beside = profiling.apply_columns(frame, ["k", "t"], F.upper, "_up")
    assert beside.columns == ["k", "n", "t", "k_up", "t_up"]
    assert [tuple(r) for r in profiling.apply_columns(frame, ["k", "t"], F.lower).orderBy("k", "n").collect()] == [("a", 3, "x"), ("a", 5, None), ("b", None, "y")]
    grouped = profiling.aggregate_by(frame, ["k"], {"span": ("n", lambda x: F.max(x) - F.min(x)), "texts": ("t", F.count)})
    assert {r["k"]: (r["span"], r["texts"]) for r in grouped.collect()} == {"a": (2, 1), "b": (None, 1)}


# --- customers -------------------------------------------------------------------------


def test_rfm(shop):
    table = {r["customer_unique_id"]: r for r in rfm.rfm(shop.orders, shop.items, shop.customers).collect()}
    # The reference date counts o4, which has no items and so no customer row.
    assert set(table) == {"u1"}
    assert (table["u1"]["recency"], table["u1"]["frequency"], table["u1"]["monetary"]) == (1, 3, 133.5)


def test_frequency_split(spark):
    frame = spark.createDataFrame([(1,), (1,), (2,), (3,)], "frequency long")
    got = {r["grupo"]: (r["clientes"], r["pct"]) for r in rfm.frequency_split(frame).collect()}
    assert got == {"freq=1": (2, 50.0), "freq>=2": (2, 50.0), "freq>=3": (1, 25.0)}


def test_robust_scale(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "a double, b double")
    scaled = cluster.robust_scale(frame, ["a", "b"]).orderBy("a").collect()
    assert [r["a_s"] for r in scaled] == pytest.approx([(x - 2.5) / 3.0 for x in (1, 2, 3, 10)])
    assert [r["b_s"] for r in scaled] == [0.0] * 4


def blobs(spark, seed=0, n=300):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.3, (n // 3, 2)) for c in [(0, 0), (5, 5), (0, 6)]])
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1]}))
    return x, frame.repartition(5)


def test_assignment_and_ties(spark):
    frame = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 0.5)], "id long, x double")
    got = as_dict(cluster.kmeans_assign(frame, ["x"], [(1, [1.0]), (0, [0.0])]), "id", "cluster")
    assert got == {1: 0, 2: 1, 3: 0}


def test_fit_recovers_separate_groups_and_cost_falls(spark):
    x, frame = blobs(spark)
    fits = cluster.kmeans_fit_all(frame, ["x", "y"], "id", [2, 3, 4], restarts=4)
    costs = [fits[k][1] for k in (2, 3, 4)]
    assert costs == sorted(costs, reverse=True)
    centers = np.array([c for _, c in fits[3][0]])
    assert np.allclose(centers, [x[:100].mean(0), x[200:].mean(0), x[100:200].mean(0)], atol=0.05) or np.allclose(
        sorted(map(tuple, centers)), sorted([tuple(x[i : i + 100].mean(0)) for i in (0, 100, 200)]), atol=0.05
    )
    assert cluster.inertia(frame, ["x", "y"], fits[3][0]).first()["inertia"] == pytest.approx(fits[3][1])
    step = cluster.kmeans_step(frame, ["x", "y"], fits[3][0]).collect()
    assert sum(r["n"] for r in step) == len(x)


def brute_silhouette(x, labels, squared):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    d = d if squared else np.sqrt(d)
    scores = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(x)) != i)
        if not same.any():
            scores.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == other].mean() for other in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def test_silhouette_against_brute_force(spark):
    x, frame = blobs(spark, 3)
    labels = (x[:, 0] > 2).astype(int) + 2 * (x[:, 1] > 5.5).astype(int)
    labels[17] = 9  # a cluster of one point scores 0
    pdf = pd.DataFrame({"id": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1], "cluster": labels})
    frame = spark.createDataFrame(pdf).repartition(4)
    row = cluster.silhouette(frame, ["x", "y"]).first()
    assert row["n"] == len(x)
    assert row["silhouette"] == pytest.approx(brute_silhouette(x, labels, False), abs=1e-8)
    squared = cluster.squared_silhouettes(frame, ["x", "y"], {0: (F.col("cluster"), [0, 1, 2, 3, 9])})[0]
    assert squared == (pytest.approx(brute_silhouette(x, labels, True)), len(x))
    row = cluster.sampled_silhouette(frame, ["x", "y"], "id").first()
    assert row["n"] == len(x) and row["silhouette"] == pytest.approx(brute_silhouette(x, labels, False))
    assert cluster.sampled_silhouette(frame, ["x", "y"], "id", sample_size=50).first()["n"] == 50


def test_starting_centres_reach_the_farthest_rows(spark):
    x, frame = blobs(spark)
    centres = cluster.starting_centres(frame, ["x", "y"], "id", 4)
    for j in range(1, 4):
        gap = np.min([((x - c) ** 2).sum(axis=1) for c in centres[:j]], axis=0)
        assert np.allclose(centres[j], x[gap.argmax()])
    # One far row among many is a centre.
    far = spark.createDataFrame([(10_000, 90.0, 90.0)], "id long, x double, y double")
    assert (90.0, 90.0) in set(map(tuple, cluster.starting_centres(frame.unionByName(far), ["x", "y"], "id", 2)))


def test_k_search_finds_the_number_of_groups(spark):
    _, frame = blobs(spark, 5)
    found = cluster.k_search(frame, ["x", "y"], "id", range(2, 6), restarts=3)
    assert [k for k, _, _ in found] == [2, 3, 4, 5]
    assert max(found, key=lambda r: (r[1], -r[0]))[0] == 3


def test_labels(spark):
    def stats(rows):
        return spark.createDataFrame(rows, "cluster long, recency double, monetary double")

    two = stats([(0, 200.0, 10.0), (1, 100.0, 50.0)])
    assert as_dict(cluster.recurrent_labels(two), "cluster", "segmento") == {0: "Cliente_Fiel_En_Riesgo", 1: "Cliente_Fiel_Activo"}
    assert as_dict(cluster.single_labels(two), "cluster", "segmento") == {0: "Esporadico_Comun", 1: "Alto_Valor_Durmiente"}
    four = stats([(0, 4.0, 1.0), (1, 3.0, 2.0), (2, 2.0, 3.0), (3, 1.0, 4.0)])
    assert as_dict(cluster.recurrent_labels(four), "cluster", "segmento") == {
        3: "Cliente_Fiel_Activo", 2: "Cliente_Fiel_Intermedio", 1: "Cliente_Fiel_En_Riesgo", 0: None,
    }
    assert as_dict(cluster.single_labels(four), "cluster", "segmento") == {0: "Esporadico_Comun", 1: None, 2: None, 3: "Alto_Valor_Durmiente"}
    tie = stats([(1, 5.0, 1.0), (0, 5.0, 1.0)])
    assert cluster.arg_extreme(tie, "recency").first().asDict() == {"cluster_min": 0, "cluster_max": 0}


def test_summary_keeps_unnamed_customers_in_the_denominator(spark):
    frame = spark.createDataFrame(
        [("a", 1, 1, 1.0, "X"), ("b", 2, 1, 2.0, "X"), ("c", 3, 1, 3.0, None), ("d", 3, 1, 3.0, "Y")],
        "customer_unique_id string, recency long, frequency long, monetary double, segmento string",
    )
    rows = {r["segmento"]: r for r in cluster.segment_summary(frame).collect()}
    assert set(rows) == {"X", "Y"}
    assert rows["X"]["pct"] == 50.0 and rows["X"]["sin_segmento"] == 1


def test_scores_ties_take_the_smallest_k(spark):
    frame = spark.createDataFrame([(4, 0.5), (2, 0.5), (3, 0.4)], "k long, silhouette double")
    assert cluster.argmax_k(frame).first()["k"] == 2


# --- location ----------------------------------------------------------------------------


def test_location_report_against_pandas(spark):
    rng = np.random.default_rng(7)
    n = 500
    # A third of all orders share one zip.
    zips = np.where(rng.random(n) < 0.34, 5, rng.integers(0, 40, n))
    rows = pd.DataFrame({
        "order_id": np.arange(n), "customer_unique_id": rng.integers(0, 200, n), "customer_city": "sp", "customer_state": "SP",
        "customer_zip_code_prefix": zips, "ingresos": rng.random(n) * 100,
    })
    geo_pdf = pd.DataFrame({"zip": np.arange(38), "lat": -23 - rng.random(38), "lng": -46 - rng.random(38)})
    geo_pdf.loc[3, "lat"] = 50.0
    order_rows, centroids = spark.createDataFrame(rows), spark.createDataFrame(geo_pdf)
    joined = rows.merge(geo_pdf, left_on="customer_zip_code_prefix", right_on="zip")
    valid = joined[joined.lat.between(-34, 5) & joined.lng.between(-74, -34)]
    lat, lng = np.average(valid.lat, weights=valid.ingresos), np.average(valid.lng, weights=valid.ingresos)
    km = np.sqrt(((valid.lat - lat) * 111) ** 2 + ((valid.lng - lng) * 111 * np.cos(np.radians(lat))) ** 2)

    totals = geo.zip_totals(order_rows.withColumn("n_orders", F.lit(1).cast("long")))
    points = geo.located(totals, centroids)
    center = geo.weighted_centroid(points)
    c = center.first()
    assert (c["lat_opt"], c["lng_opt"], c["n_orders"]) == (pytest.approx(lat), pytest.approx(lng), len(valid))
    assert c["lat_simple"] == pytest.approx(valid.lat.mean())
    cover = geo.coverage_stats(points, center).first()
    assert cover["km_mean"] == pytest.approx(km.mean())
    assert cover["km_median"] == pytest.approx(km.median())
    assert cover["km_p80"] == pytest.approx(np.percentile(km, 80))
    assert geo.match_coverage(totals, centroids).first().asDict() == {"n_orders": n, "n_matched": len(joined), "n_valid": len(valid)}
    assert geo.join_geo(order_rows, centroids).count() == len(valid)


def test_city_in_two_states(shop):
    report = questions.store_location(shop)
    cities = {(r["customer_city"], r["customer_state"]): r for r in report.cities.collect()}
    assert set(cities) == {("santos", "SP")}
    assert cities[("santos", "SP")]["clientes_unicos"] == 1
    assert report.matches.first()["n_valid"] == 3


def test_zero_weights_have_no_centre(spark):
    points = spark.createDataFrame([(1.0, 2.0, 0.0, 3)], "lat double, lng double, ingresos double, n_orders long")
    assert geo.weighted_centroid(points).first()["lat_opt"] is None


# --- knowledge base and context --------------------------------------------------------------


def test_catalog_document_round_trip(spark):
    totals = spark.createDataFrame(
        [("health_beauty", 9465, 1.0, 130.279, 1.2, 3124.0), ("bed_bath_table", 10953, 1.0, 93.44, 6.99, 1999.98), ("other", 1, 1.0, 1.0, 1.0, 1.0)],
        "categoria string, units long, revenue double, avg_price double, min_price double, max_price double",
    )
    products = catalog.catalog_products(catalog.curated_products(spark), catalog.price_stats(totals))
    path = fresh_path(spark, "kb")
    documents.write_json_document(catalog.catalog_doc(products), path)
    loaded = documents.read_catalog(spark, path).orderBy("id").collect()
    assert [r["id"] for r in loaded] == ["PROD-001", "PROD-002"]
    assert loaded[0]["precio_promedio_real"] == 130.28 and loaded[0]["rango_precios"]["maximo"] == 3124.0
    assert catalog.catalog_filter(products, tag="hogar").first()["id"] == "PROD-002"
    assert catalog.catalog_filter(products, price_between=(100.0, 200.0), featured=True).first()["id"] == "PROD-001"


def test_rendered_prompt(spark):
    segmented = spark.createDataFrame(
        [("u1", 515, 2, 7388.0, "Cliente_Fiel_Activo"), ("u2", 692, 2, 151.0, "Cliente_Fiel_En_Riesgo"), ("u3", 334, 1, 13440.0, "Alto_Valor_Durmiente")],
        "customer_unique_id string, recency long, frequency long, monetary double, segmento string",
    )
    complaint = spark.createDataFrame([("u2", "r", "Logistica_Retrasos", 'disse "sim"')], "customer_unique_id string, review_id string, queja_categoria string, queja_detalle string")
    crm = spark.createDataFrame([("u1", 27, "Femenino"), ("u2", 62, "Masculino")], "customer_unique_id string, edad int, genero string")
    totals = spark.createDataFrame(
        [("health_beauty", 9465, 1.0, 130.28, 1.2, 3124.0), ("watches_gifts", 5859, 1.0, 199.04, 8.99, 3999.9)],
        "categoria string, units long, revenue double, avg_price double, min_price double, max_price double",
    )
    products = catalog.catalog_products(catalog.curated_products(spark), catalog.price_stats(totals))
    profiles = context.customer_profiles(segmented, complaint, crm)
    prompts = {r["customer_unique_id"]: r for r in context.render_context(profiles, products).collect()}
    assert {u: r["persona"] for u, r in prompts.items()} == {"u1": "Luna", "u2": "Marco", "u3": "VIP"}
    text = prompts["u2"]["system_prompt"]
    parts = text.split("\n\n")
    assert parts[0] == fixed_values.PERSONAS["Marco"]["opening"] and parts[-1] == fixed_values.PERSONAS["Marco"]["closing"]
    profile = {
        "edad": 62, "genero": "Masculino", "segmento_crm": "Cliente_Fiel_En_Riesgo",
        "historial_compras": "cliente recurrente (2 compras), gasto acumulado medio de R$151, inactivo hace 692 dias.",
        "experiencia_negativa_previa": {"categoria": "Logistica_Retrasos", "detalle_original": 'disse "sim"'},
    }
    assert parts[1] == "PERFIL DEL CLIENTE:\n" + json.dumps(profile, indent=2, ensure_ascii=False)
    shown = [
        {
            "id": p["id"], "nombre": p["nombre"], "categoria": p["categoria"], "descripcion": p["descripcion"],
            "precio_promedio_R$": price, "rango_precios_R$": {"minimo": low, "maximo": high}, "unidades_vendidas": units, "tags": p["tags"],
        }
        for p, price, low, high, units in [
            (fixed_values.CURATED_PRODUCTS[0], 130.28, 1.2, 3124.0, 9465), (fixed_values.CURATED_PRODUCTS[2], 199.04, 8.99, 3999.9, 5859),
        ]
    ]
    assert parts[2] == "CATALOGO:\n" + json.dumps(shown, indent=2, ensure_ascii=False)
    assert "experiencia_negativa_previa" not in prompts["u1"]["system_prompt"]
    compact = as_dict(context.with_profile_json(profiles), "customer_unique_id", "perfil_json")
    assert json.loads(compact["u2"]) == profile and "edad" not in json.loads(compact["u3"])


def test_exemplar(spark):
    frame = spark.createDataFrame([("a", 1, 1, 5.0, "X"), ("b", 1, 1, 9.0, "X"), ("c", 1, 1, 99.0, None)], "customer_unique_id string, recency long, frequency long, monetary double, segmento string")
    assert [tuple(r) for r in context.segment_exemplar(frame).collect()] == [("X", "b", 1, 1, 9.0)]


# --- recommendations ---------------------------------------------------------------------------


def baskets(spark, seed=0):
    """One customer bought nearly everything, one product is in every basket."""
    rng = np.random.default_rng(seed)
    rows = {("hot", p) for p in range(0, 150, 2)} | {("hot2", p) for p in range(0, 120)}
    for c in range(40):
        rows |= {(f"c{c}", int(p)) for p in rng.integers(0, 150, rng.integers(1, 9))} | {(f"c{c}", 0)}
    frame = spark.createDataFrame([(c, p, 1, 1.0) for c, p in sorted(rows)], "customer string, product long, units long, spend double")
    by_customer = {}
    for c, p in rows:
        by_customer.setdefault(c, set()).add(p)
    return frame.repartition(6), by_customer


def brute_pairs(by_customer):
    pairs = Counter()
    for products in by_customer.values():
        pairs.update(itertools.combinations(sorted(products), 2))
    return pairs


@pytest.mark.parametrize("part_size", [4, 16, 1000])
def test_every_pair_is_counted_and_compared(spark, part_size):
    """More than ten companions a product, each pair once, whatever a basket is cut into."""
    frame, by_customer = baskets(spark)
    want = brute_pairs(by_customer)
    assert max(Counter(p for pair in want for p in pair).values()) > 10
    pairs = recommend.item_cooccurrence(frame, part_size)
    assert {(r["product_a"], r["product_b"]): r["n_customers"] for r in pairs.collect()} == dict(want)
    buyers = Counter(p for products in by_customer.values() for p in products)
    got = recommend.item_similarity(pairs, frame).collect()
    assert {(r["product_a"], r["product_b"]): r["similarity"] for r in got} == pytest.approx({(a, b): n / math.sqrt(buyers[a] * buyers[b]) for (a, b), n in want.items()})
    assert len(got) == len(want)


@pytest.mark.parametrize("name, columns", [("item_cooccurrence", ["product_a", "product_b", "n_customers"]), ("item_cf_similarity", ["product_a", "product_b", "similarity"])])
def test_pair_queries_return_every_pair(spark, name, columns):
    """A customer with thirty products has 435 pairs; none is left out and no rank cuts them."""
    folder = fresh_path(spark, "shop")
    write = lambda table, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    write("region", [(0, "r")], proxies.TABLES["region"])
    write("nation", [(0, "n", 0)], proxies.TABLES["nation"])
    write("customer", [(1, "c", 0, 0.0, "m")], proxies.TABLES["customer"])
    write("orders", [(1, 1, "F", 1.0, datetime(2024, 1, 1), "1")], proxies.TABLES["orders"])
    write("lineitem", [(1, p, 1, p, 1.0, 1.0, 0.0, 0.0, "N", "O", datetime(2024, 1, 2)) for p in range(30)], proxies.TABLES["lineitem"])
    got = QUERIES[name](spark, folder)
    assert got.columns == columns
    assert sorted((r["product_a"], r["product_b"], r[2]) for r in got.collect()) == [(a, b, 1) for a in range(30) for b in range(a + 1, 30)]


@pytest.mark.parametrize("part_size, hot, held", [(512, 50_000, 200_000), (4, 50_000, 5), (16, 3, 40), (1000, 1, 1)])
@pytest.mark.parametrize("cosine", [True, False])
def test_neighbours_against_all_pairs(spark, part_size, hot, held, cosine):
    """Large baskets in parts, hot products dealt out, bounds applied after few rows: always the k best of all pairs."""
    frame, by_customer = baskets(spark)
    buyers = Counter(p for products in by_customer.values() for p in products)
    values: dict[int, list] = {}
    for (a, b), n in brute_pairs(by_customer).items():
        value = n / math.sqrt(float(buyers[a]) * buyers[b]) if cosine else n
        values.setdefault(a, []).append((-value, b, n))
        values.setdefault(b, []).append((-value, a, n))
    want = sorted((a, b, n, rank) for a, rows in values.items() for rank, (_, b, n) in enumerate(sorted(rows)[:3], 1))
    with_null = frame.unionByName(spark.createDataFrame([(None, 1), (None, 2)], "customer string, product long"), allowMissingColumns=True)
    got = recommend.top_neighbours(with_null, 3, cosine, part_size, hot, held).collect()
    assert sorted((r["product_a"], r["product_b"], r["n_customers"], r["rank"]) for r in got) == want


def test_neighbours_are_not_counted_that_cannot_be_best():
    """Many baskets with two steady companions and ever new others: the others stop being counted."""
    own = recommend._Neighbours(buyers=500, k=2, cosine=True, held=50)
    rng = np.random.default_rng(1)
    met = 0
    for i in range(500):
        others = np.unique(np.concatenate([[1, 2], rng.integers(100, 10**6, 30)]))
        met += len(others)
        own.add(others, np.where(others < 100, 500, 40), True)
    own.merge()
    assert own.other[own.best()].tolist() == [1, 2] and own.n[own.best()].tolist() == [500, 500]
    assert len(own.other) == 2


def in_segments(spark, by_customer, pool_size):
    """Two segments, each with a pool of its own."""
    named = {c: "a" if i % 2 else "b" for i, c in enumerate(sorted(by_customer))}
    segments = spark.createDataFrame(list(named.items()), "customer string, segmento string")
    products = sorted({p for bought in by_customer.values() for p in bought})
    pools = {"a": products[:pool_size], "b": products[pool_size // 2 : 2 * pool_size]}
    pool = spark.createDataFrame([(s, p, i + 1) for s, ps in pools.items() for i, p in enumerate(ps)], "segmento string, product long, rank long")
    return named, pools, segments, pool


@pytest.mark.parametrize("share", [0.0, 0.5])
def test_item_cf_over_the_pool_against_brute_force(spark, share):
    frame, by_customer = baskets(spark, 1)
    named, pools, segments, pool = in_segments(spark, by_customer, 20)
    chosen = sorted(by_customer)[:3]
    signals = [(c, p, 0.25 * (p % 3)) for c in chosen for p in range(0, 60, 7)]
    implicit = spark.createDataFrame(signals, "customer_id string, product_id long, score double")
    buyers = Counter(p for products in by_customer.values() for p in products)
    sim = {}
    for (a, b), n in brute_pairs(by_customer).items():
        sim.setdefault(a, {})[b] = sim.setdefault(b, {})[a] = n / math.sqrt(buyers[a] * buyers[b])
    want = {}
    for c, products in by_customer.items():
        scores = Counter()
        for p in products:
            for q, s in sim.get(p, {}).items():
                if q not in products and q in pools[named[c]]:
                    scores[q] += s
        for customer, q, s in signals:
            if share and customer == c and q not in products and q in pools[named[c]]:
                scores[q] += share * s
        ranked = sorted(scores, key=lambda q: (-round(scores[q], 6), q))[:5]
        want[c] = [(q, round(scores[q], 6)) for q in ranked]
    got = {}
    for r in recommend.item_cf_rank(frame, segments, pool, 5, implicit, share).orderBy("customer", "rank").collect():
        got.setdefault(r["customer"], []).append((r["product"], r["score"]))
    assert got == {c: r for c, r in want.items() if r}


@pytest.mark.parametrize("band_size", [10, 1_000_000])
def test_content_neighbours_against_brute_force(spark, band_size):
    rng = np.random.default_rng(2)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{i % 5}", float(rng.integers(0, 60))) for i in range(200)]
    frame = spark.createDataFrame(rows, "product long, categoria string, price double")
    got = {}
    for r in recommend.content_similarity(frame, 3, band_size).orderBy("product", "rank").collect():
        got.setdefault(r["product"], []).append(r["price_gap"])
    for i, kind, price in rows:
        gaps = sorted(abs(p - price) for j, k, p in rows if k == kind and j != i)[:3]
        assert got.get(i, []) == gaps


def test_price_bands_do_not_change_the_neighbours(spark):
    rng = np.random.default_rng(6)
    # Many equal prices, so that bands differ much in size.
    rows = [(i, "one", float(min(rng.integers(0, 400), 300))) for i in range(500)]
    frame = spark.createDataFrame(rows, "product long, categoria string, price double")
    columns = ["product", "neighbour", "rank"]
    banded, plain = (sorted(map(tuple, recommend.content_similarity(frame, 4, size).select(columns).collect())) for size in (50, 10_000))
    assert banded == plain
    own = recommend.price_bands(frame, 4, 50).filter("own")
    assert own.count() == 500 and own.select("band").distinct().count() >= 8
    assert own.groupBy("band").count().agg(F.max("count")).first()[0] <= 100


def test_routes_cover_every_customer(spark):
    frame, by_customer = baskets(spark, 3)
    everyone = frame.select("customer").distinct().unionByName(spark.createDataFrame([("new",)], "customer string"))
    routes = recommend.recommend_route(everyone, frame, rich_from=4)
    kinds = as_dict(routes, "customer", "route")
    assert kinds["new"] == "popular" and kinds["hot"] == "item_cf"
    assert all((len(p) >= 4) == (kinds[c] == "item_cf") for c, p in by_customer.items())
    features = spark.createDataFrame([(i, "all", float(i), [f"t{i % 3}"]) for i in range(150)], "product long, categoria string, price double, traits array<string>")
    named, pools, segments, pool = in_segments(spark, by_customer, 30)
    served = recommend.recommend(routes, frame, segments, pool, features, recommend.product_popularity(frame), 5)
    rows = served.collect()
    # Whoever bought the whole pool has no candidate left.
    left = {c for c in kinds if kinds[c] == "popular" or set(pools[named[c]]) - by_customer[c]}
    assert "hot2" not in left and {r["customer"] for r in rows} == left and max(r["rank"] for r in rows) <= 5
    assert all(r["product"] in pools[named[r["customer"]]] for r in rows if r["route"] != "popular")
    for r in rows:
        if r["route"] == "content":
            want = max(1 / (1 + abs(p - r["product"])) + (p % 3 == r["product"] % 3) for p in by_customer[r["customer"]])
            assert r["score"] == pytest.approx(want, abs=1e-6)
    bought = {(c, p) for c, products in by_customer.items() for p in products}
    assert not bought & {(r["customer"], r["product"]) for r in rows}


def test_feedback_join_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = pd.Timestamp("2024-01-01")
    def rows(n):
        # A third of all rows belongs to one customer and product; times tie often.
        return [(i, 0 if rng.random() < 0.34 else int(rng.integers(5)), 0 if rng.random() < 0.5 else 1, base + pd.Timedelta(minutes=int(rng.integers(0, 3000)))) for i in range(n)]
    s, a = rows(150), [(*r, "click" if r[0] % 2 else "purchase") for r in rows(150)]
    served = spark.createDataFrame(pd.DataFrame(s, columns=["served_id", "customer_id", "product_id", "ts"]))
    actions = spark.createDataFrame(pd.DataFrame(a, columns=["action_id", "customer_id", "product_id", "ts", "action"]))
    window = 7200
    got = {r["served_id"]: (r["action"], r["delay_seconds"]) for r in feedback.feedback_join(served, actions, window).collect()}
    for sid, c, p, ts in s:
        later = sorted((t, i, kind) for i, ac, ap, t, kind in a if (ac, ap) == (c, p) and ts < t <= ts + pd.Timedelta(seconds=window))
        want = (later[0][2], (later[0][0] - ts).total_seconds()) if later else (None, None)
        assert got[sid] == want
    assert len(got) == len(s)


def test_feedback_with_null_keys_is_unanswered(spark):
    served = spark.sql("SELECT * FROM VALUES (1, 1, null, timestamp'2024-01-01 00:00:00'), (2, null, 5, timestamp'2024-01-01 00:00:00'), (3, 1, 5, timestamp'2024-01-01 00:00:00') t(served_id, customer_id, product_id, ts)")
    actions = spark.sql("SELECT * FROM VALUES (1, 1, null, timestamp'2024-01-01 00:01:00', 'click'), (2, null, 5, timestamp'2024-01-01 00:01:00', 'click'), (3, 1, 5, timestamp'2024-01-01 00:01:00', 'click') t(action_id, customer_id, product_id, ts, action)")
    got = as_dict(feedback.feedback_join(served, actions), "served_id", "action")
    assert got == {1: None, 2: None, 3: "click"}


def test_published_version_is_replaced(spark):
    base = fresh_path(spark, "published")
    documents.publish(spark.createDataFrame([(1,)], "x long"), base)
    documents.publish(spark.createDataFrame([(2,)], "x long"), base)
    assert [r["x"] for r in documents.read_published(spark, base).collect()] == [2]


def test_publishing_goes_on_after_dead_writers(spark):
    """Left behind: a folder for a pointer, an empty pointer, one to an unfinished version."""
    base = fresh_path(spark, "published")
    with pytest.raises(FileNotFoundError):
        documents.read_published(spark, base)
    read = lambda: [r["x"] for r in documents.read_published(spark, base).collect()]
    frame = lambda x: spark.createDataFrame([(x,)], "x long")
    documents.publish(frame(1), base)
    os.makedirs(f"{base}/current/number=2")
    open(f"{base}/current/3", "w").close()
    os.makedirs(f"{base}/versions/unfinished")
    with open(f"{base}/current/4", "w") as pointer:
        pointer.write("unfinished")
    assert read() == [1]
    documents.publish(frame(5), base)
    assert read() == [5] and os.path.isfile(f"{base}/current/5")


def test_two_writers_of_one_number(spark, monkeypatch):
    """Both see the same newest number; neither fails and the later one is current."""
    base = fresh_path(spark, "published")
    documents.publish(spark.createDataFrame([(1,)], "x long"), base)
    before = documents._entries(spark, base)
    monkeypatch.setattr(documents, "_entries", lambda *_: before)
    documents.publish(spark.createDataFrame([(2,)], "x long"), base)
    documents.publish(spark.createDataFrame([(3,)], "x long"), base)
    monkeypatch.undo()
    assert [n for n, _ in documents._entries(spark, base)] == [3, 2, 1]
    assert [r["x"] for r in documents.read_published(spark, base).collect()] == [3]


# --- profiles and files --------------------------------------------------------------------------


def test_profile_and_sample(spark):
    frame = spark.createDataFrame([(1, None), (2, "a"), (3, "a")], "id long, s string")
    nulls = as_dict(profiling.profile_table(frame, "t"), "column_name", "n_null")
    assert nulls == {"id": 0, "s": 1}
    assert [tuple(r) for r in profiling.value_counts(frame, "s").collect()] == [("a", 2)]
    many = spark.range(1000)
    one = {r["id"] for r in profiling.sample_fixed(many, "id", 10).collect()}
    two = {r["id"] for r in profiling.sample_fixed(many.repartition(7), "id", 10).collect()}
    assert one == two and len(one) == 10
    assert one == {r["id"] for r in many.orderBy(scalars.hash_order(F.col("id"), 42), "id").limit(10).collect()}
    assert profiling.sample_fixed(many, "id", 5000).count() == 1000 and profiling.sample_fixed(many.limit(0), "id", 5).count() == 0


def test_csv_dialect(spark, tmp_path):
    path = tmp_path / "order_reviews_dataset.csv"
    path.write_text(
        '﻿"review_id","order_id","extra","review_score","review_comment_message"\n'
        'r1,o1,x,1,"linha um\nlinha ""dois"", fim"\nr2,o2,x,5,\nr3,o3,x,2,NA\n',
        encoding="utf-8",
    )
    from bazarlens.schemas import ORDER_REVIEWS

    rows = tables.read_csv(spark, str(path), ORDER_REVIEWS).orderBy("review_id").collect()
    assert rows[0]["review_comment_message"] == 'linha um\nlinha "dois", fim'
    assert [r["review_score"] for r in rows] == [1, 5, 2]
    assert rows[1]["review_comment_message"] is None and rows[2]["review_comment_message"] is None


def test_shared_folder_is_required_on_a_cluster(spark):
    from unittest import mock

    from bazarlens import session as session_module

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        session_module.shared_dir(Cluster)
    with mock.patch.object(Cluster.conf, "get", staticmethod(lambda name, default=None: "hdfs://shared/")):
        assert session_module.shared_dir(Cluster) == "hdfs://shared"
