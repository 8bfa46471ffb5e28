import numpy as np
from pyspark.sql import functions as F

from bazarlens.llm.vector_forest import Forest, nearest
from tests.llm.support import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, matrix, queries, k):
    result = {}
    for q in queries:
        i = list(ids).index(q)
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-float(matrix[j] @ matrix[i]), ids[j]))
        result[q] = [ids[j] for j in order[:k]]
    return result


def test_recall_and_exact_scores_on_the_test_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = frame.collect()
    ids = [r["vec_id"] for r in rows]
    matrix = np.array([r["embedding"] for r in rows], np.float64)
    wanted = brute(ids, matrix, [i for i in ids if i % 20 == 0], 20)
    found = {}
    for r in nearest(frame, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == set(wanted) and all(sorted(x) == list(range(1, 21)) for x in found.values())
    hits = sum(len({v for v, _ in found[q].values()} & set(wanted[q])) for q in wanted)
    assert hits >= 0.9 * 20 * len(wanted)
    place = {v: i for i, v in enumerate(ids)}
    for q, ranks in found.items():
        scores = [ranks[i][1] for i in range(1, 21)]
        assert scores == sorted(scores, reverse=True)
        assert all(abs(s - matrix[place[q]] @ matrix[place[v]]) < 1e-12 for v, s in ranks.values())


def test_lengths_differ_largest_inner_product_wins(spark):
    generator = np.random.default_rng(5)
    matrix = (generator.standard_normal((400, 8)) * generator.uniform(0.1, 5, (400, 1))).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(matrix)], SCHEMA)
    found = {}
    for r in nearest(frame, F.col("vec_id") % 20 == 0, k=5).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    wanted = brute(list(range(400)), matrix.astype(np.float64), range(0, 400, 20), 5)
    assert sum(len(found[q] & set(wanted[q])) for q in wanted) >= 0.9 * 5 * len(wanted)


def test_ties_copies_and_unusable_rows(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(i, same, 0) for i in range(0, 60)]
    rows += [(100, None, 0), (120, [0.0, 0.0, 0.0], 0), (140, [1.0, None, 0.0], 0), (160, [float("nan"), 0.0, 0.0], 0), (180, [float("inf"), 0.0, 0.0], 0), (None, same, 0), (200, [1.0, 1.0], 0), (220, [-1.0, 0.5, 0.0], 0)]
    rows += [(3, same, 0)]
    result = nearest(clashing(spark.createDataFrame(rows, SCHEMA)), F.col("vec_id") % 20 == 0, k=7).collect()
    found = {}
    for r in sorted(result, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == {0, 20, 40, 220}
    assert found[0] == [(i, 1.0) for i in range(1, 8)]
    assert found[20] == [(i, 1.0) for i in range(7)]
    assert found[220] == [(i, -1.0) for i in range(7)]


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 0)], SCHEMA)
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in nearest(frame, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 4.0)]
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0, settings=Forest(trees=2)).count() == 0
