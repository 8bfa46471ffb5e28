import hashlib
import math
import random

from pyspark.sql import functions as F

from bazarlens.llm.centroids import LARGEST, Centroids, cluster_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, s):
    """The contract in loops: {(vec_id, position)}: (cluster, distance, cluster inertia, inertia, digest)."""
    usable = [(i, [math.floor(s.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == s.components and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(usable, key=lambda r: (r[0] is None, hashlib.sha256(f"{s.seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[: s.clusters]]

    def assign():
        found = []
        for _, v in usable:
            found.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres)))
        return found

    for _ in range(s.rounds):
        own = assign()
        for k in range(len(centres)):
            mine = [v for (_, v), (_, j) in zip(usable, own) if j == k]
            if mine:
                centres[k] = [sum(column) // len(mine) for column in zip(*mine)]
    own = assign()
    total = sum(d for d, _ in own)
    rows = []
    for (i, _), (d, k) in zip(usable, own):
        digest = hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()
        rows.append((i, k, d, sum(e for e, j in own if j == k), total, digest))
    return sorted(rows, key=repr)


def run(spark, rows, settings):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for name in ("cluster", "distance", "v", "inertia", "own", "h"):
        frame = frame.withColumn(name, F.lit("x"))
    return cluster_vectors(frame, settings)


def made(n, dims, seed):
    random.seed(seed)
    # Multiples of 1/1024 and ties among them.
    return [(i, [random.choice([-1, 0, 0, 1]) * random.randint(0, 3000) / 1024 for _ in range(dims)]) for i in range(n)]


def test_equals_plain_loops(spark):
    settings = Centroids(components=5, clusters=4, rounds=6)
    rows = made(120, 5, 1)
    # Repeated vectors, repeated ids, no id, and what takes no part.
    rows += [(3, rows[3][1]), (3, rows[7][1]), (None, rows[5][1]), (200, None), (201, [0.5] * 4), (202, [0.5] * 6), (203, []), (204, [0.1, None, 0.2, 0.3, 0.4])]
    rows += [(205, [math.nan] * 5), (206, [math.inf, 0.0, 0.0, 0.0, 0.0]), (207, [0.5] * 5)]
    got = sorted((tuple(r) for r in run(spark, rows, settings).collect()), key=repr)
    assert got == plain(rows, settings)


def test_empty_clusters_stay_and_equal_vectors(spark):
    settings = Centroids(components=3, clusters=4, rounds=3)
    rows = [(i, [1.0, -2.5, 0.25]) for i in range(10)] + [(10, [9.0, 9.0, 9.0])]
    got = sorted((tuple(r) for r in run(spark, rows, settings).collect()), key=repr)
    assert got == plain(rows, settings)


def test_few_vectors_none_and_huge_components(spark):
    settings = Centroids(components=3, clusters=8)
    assert len(run(spark, made(3, 3, 4), settings).collect()) == 3
    nothing = run(spark, [(1, None)], settings)
    assert nothing.count() == 0
    assert nothing.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    big = run(spark, [(1, [3e38, 0.0, 0.0]), (2, [-3e38, 0.0, 0.0])], Centroids(components=3, clusters=1, rounds=0)).collect()
    assert sorted(r["distance"] for r in big) == [0, (2 * LARGEST) ** 2]


def test_result_schema_and_plan(spark):
    frame = run(spark, made(50, 4, 2), Centroids(components=4, clusters=2))
    assert dict(frame.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
