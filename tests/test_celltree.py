import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bazarlens.operators import celltree, cluster
from bazarlens.operators.celltree import CellTree, cell_nodes, distance_sums, euclidean_silhouettes, far_apart, node_shares, owners


def made(seed, n=900):
    """A dense middle, a long tail, many equal rows and a column with few values."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 1, (n // 3, 2)), np.stack([rng.integers(0, 12, n // 3), rng.exponential(6, n // 3)], axis=1), np.tile([[2.0, 3.0]], (n // 3, 1))]
    return np.concatenate(parts)


def frame_of(spark, x, **more):
    pdf = pd.DataFrame({"id": np.arange(len(x)), **{c: x[:, i] for i, c in enumerate("xyz"[: x.shape[1]])}, **more})
    return spark.createDataFrame(pdf).repartition(5)


def plain_update(x, centres):
    gap = ((x[:, None] - centres[None]) ** 2).sum(2)
    own = gap.argmin(1)
    moved = np.array([x[own == j].mean(0) if (own == j).any() else c for j, c in enumerate(centres)])
    return moved, gap.min(1).sum()


def plain_fit(x, start):
    centres, cost = start, None
    for _ in range(300):
        moved, cost = plain_update(x, centres)
        if np.abs(moved - centres).max() <= cluster.STANDSTILL:
            return centres, cost
        centres = moved
    raise AssertionError("still moving")


@pytest.mark.parametrize("bits, held", [(14, 1 << 18), (6, 1 << 18), (6, 0), (4, 400), (0, 1 << 18)])
def test_update_is_that_of_all_rows(spark, bits, held):
    """Rows held, rows added up by a job, and both at once; one cell and many."""
    x = made(1)
    tree = CellTree.build(frame_of(spark, x), ["x", "y"], bits=bits, held_rows=held)
    assert tree.levels[0].n.tolist() == [len(x)] and tree.levels[-1].n.sum() == len(x)
    rng = np.random.default_rng(2)
    models = [x[rng.choice(len(x), k, replace=False)] for k in (2, 3, 6)] + [np.array([[1.0, 1.0], [1.0, 1.0], [99.0, 99.0]])]
    for _ in range(3):
        moved, costs = tree.update(models)
        for centres, got, cost in zip(models, moved, costs):
            want, want_cost = plain_update(x, centres)
            assert np.allclose(got, want, atol=1e-9) and cost == pytest.approx(want_cost)
        models = moved
    assert len(tree.held) <= held


def test_three_columns_and_unusable_rows(spark):
    x = np.random.default_rng(3).normal(0, 2, (400, 3))
    bad = spark.createDataFrame([(900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0), (902, float("inf"), 1.0, 1.0)], "id long, x double, y double, z double")
    tree = CellTree.build(frame_of(spark, x).unionByName(bad), ["x", "y", "z"])
    assert tree.levels[-1].n.sum() == 400
    moved, _ = tree.update([x[:4]])
    assert np.allclose(moved[0], plain_update(x, x[:4])[0])


def test_owned_boxes_hold_no_other_nearest():
    rng = np.random.default_rng(4)
    low = rng.normal(0, 3, (500, 2))
    high = low + rng.exponential(0.7, (500, 2))
    centres = rng.normal(0, 3, (5, 2))
    own = owners(low, high, centres)
    assert (own >= 0).any() and (own < 0).any()
    inside = low[:, None] + rng.random((500, 200, 2)) * (high - low)[:, None]
    nearest = ((inside[:, :, None] - centres) ** 2).sum(3).argmin(2)
    assert (nearest[own >= 0] == own[own >= 0, None]).all()


def test_fit_reads_few_rows(spark):
    """The centres of plain k-means, from a small part of the rows that its passes would read."""
    x = np.concatenate([np.random.default_rng(5).normal(c, 1.0, (4000, 2)) for c in [(0, 0), (4, 1), (1, 5)]])
    frame = frame_of(spark, x)
    fits = cluster.kmeans_fit_all(frame, ["x", "y"], "id", [3, 4], restarts=3)
    starts = cluster.starting_centres_all(frame, ["x", "y"], "id", 4, range(42, 45))
    for k in (3, 4):
        found = [plain_fit(x, s[:k]) for s in starts]
        centres, cost = min(found, key=lambda f: f[1])
        assert np.allclose([c for _, c in fits[k][0]], sorted(map(tuple, centres)), atol=1e-7)
        assert fits[k][1] == pytest.approx(cost)
    tree = CellTree.build(frame, ["x", "y"])
    models, passes = [s[:3] for s in starts], 0
    while models and passes < 200:
        moved, _ = tree.update(models)
        models = [m for m, c in zip(moved, models) if np.abs(m - c).max() > cluster.STANDSTILL]
        passes += 1
    assert passes > 5 and tree.rows_read <= passes * len(x) / 10


def test_standing_in_for_far_points():
    rng = np.random.default_rng(6)
    sources = rng.random((300, 2)) * [2.0, 0.5]
    targets = rng.random((200, 2)) + [6.0, 0.3]
    low, high = sources.min(0), sources.max(0)
    assert far_apart(targets.min(0), targets.max(0), low, high)
    assert np.allclose(node_shares(sources, low, high).sum(1), 1)
    weights = rng.random((300, 2))
    exact = celltree._direct(targets, sources, weights)
    nodes = celltree._direct(targets, cell_nodes(low, high), node_shares(sources, low, high).T @ weights)
    assert np.abs(nodes / exact - 1).max() < 3e-8
    # Boxes without extent in a dimension, or in none.
    flat = np.stack([np.zeros(200), rng.random(200)], axis=1)
    assert np.allclose(node_shares(flat, flat.min(0), flat.max(0)) @ cell_nodes(flat.min(0), flat.max(0)), flat)


def test_distance_sums_of_clustered_points():
    x = made(7, 3000)
    weights = np.random.default_rng(7).random((len(x), 3))
    exact = celltree._direct(x, x, weights)
    assert np.abs(distance_sums(x, x, weights) / exact - 1).max() < 3e-8


def brute(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    scores = []
    for i, own in enumerate(labels):
        if own is None:
            continue
        same = (labels == own) & (np.arange(len(x)) != i)
        others = [d[i, labels == o].mean() for o in set(labels) - {own, None}]
        a, b = (d[i, same].mean(), min(others)) if same.any() else (0.0, 0.0)
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores)), len(scores)


@pytest.mark.parametrize("group_rows", [10_000, 60, 8])
def test_silhouettes_of_several_labellings(spark, group_rows):
    x = made(8, 1500)
    frame = frame_of(spark, x)
    three = F.when(F.col("x") > 3, 7).when(F.col("y") > 5, 4).otherwise(2)
    some = F.when(F.col("id") == 5, 1).when(F.col("x") < 8, 0)
    found = euclidean_silhouettes(frame, ["x", "y"], {"a": (three, [2, 4, 7, 11]), "b": (some, [0, 1])}, group_rows)
    a = np.where(x[:, 0] > 3, 7, np.where(x[:, 1] > 5, 4, 2)).astype(object)
    b = np.where(np.arange(len(x)) == 5, 1, np.where(x[:, 0] < 8, 0, None))
    assert found["a"] == (pytest.approx(brute(x, a)[0], abs=1e-8), brute(x, a)[1])
    assert found["b"] == (pytest.approx(brute(x, b)[0], abs=1e-8), brute(x, b)[1])


def test_silhouettes_of_one_and_three_columns(spark):
    rng = np.random.default_rng(9)
    for dims in (1, 3):
        x = np.concatenate([rng.normal(0, 1, (200, dims)), rng.normal(5, 1, (150, dims))])
        labels = (np.arange(350) >= 200).astype(int)
        frame = frame_of(spark, x, c=labels)
        found = euclidean_silhouettes(frame, list("xyz"[:dims]), {0: (F.col("c"), [0, 1])}, 40)
        assert found[0] == (pytest.approx(brute(x, labels)[0], abs=1e-8), 350)


def test_a_task_holds_what_meets_in_one_cell(spark, monkeypatch):
    """Points are sent by tasks of few rows, and no task sorts the rows of two target cells."""
    x = made(3, 1500)
    frame = frame_of(spark, x, c=(x[:, 0] > 3).astype(int))
    kind, met = type(frame), []
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: met.append(self) or plain(self, *a, **b))
    monkeypatch.setattr(celltree, "MEETING_ROWS", 2000, raising=False)
    found = euclidean_silhouettes(frame, ["x", "y"], {0: (F.col("c"), [0, 1])}, 20)
    assert found[0] == (pytest.approx(brute(x, (x[:, 0] > 3).astype(int))[0], abs=1e-8), len(x))
    meeting = next(m for m in met if "target" in m.columns)
    per_task = meeting.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("target").alias("targets")).collect()
    assert len(per_task) > 10 and {r["targets"] for r in per_task} == {1}


def test_one_cluster_has_no_silhouette(spark):
    with pytest.raises(ValueError):
        euclidean_silhouettes(frame_of(spark, made(1, 30)), ["x", "y"], {0: (F.lit(0), [0, 1])})


def test_border_rows_are_added_up_per_cluster_and_not_per_cell(spark):
    """With no rows held: one row per model and cluster comes back, however many cells a border crosses, and an update is plain Lloyd's."""
    x = np.random.default_rng(5).normal(size=(4000, 2))
    frame = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    tree = celltree.CellTree.build(frame, ["a", "b"], bits=8, held_rows=0)
    models = [x[:2], x[2:5]]
    borders = [tree.totals(centres)[3] for centres in models]
    cells = np.unique(np.concatenate(borders))
    found = tree.add_up_rows(models, cells, borders)
    assert len(cells) > 20 and {i: len(rows) for i, rows in found.items()} == {0: 2, 1: 3}
    assert [sum(r[1] for r in found[i]) for i in range(2)] == [tree.levels[-1].n[b].sum() for b in borders]
    moved, costs = tree.update(models)
    for centres, new, cost in zip(models, moved, costs):
        gap = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        own = gap.argmin(axis=1)
        np.testing.assert_allclose(new, [x[own == j].mean(axis=0) for j in range(len(centres))], rtol=1e-9)
        assert cost == pytest.approx(gap.min(axis=1).sum())


def test_a_scan_of_many_cells_is_told_few_ranges(spark):
    """Thousands of ranges are more than compiled code holds; the rows of other cells are left out by the tasks."""
    x = np.random.default_rng(8).normal(size=(6000, 2))
    frame = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    tree = CellTree.build(frame, ["a", "b"], bits=12, held_rows=4000)
    cells = np.arange(0, len(tree.codes), 2)
    told = tree.rows.where(tree._among(cells))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 < told.count("cell") < 3 * celltree.SCAN_RANGES
    centres = x[:3]
    found = tree.add_up_rows([centres], cells, [cells])
    assert sum(r[1] for r in found[0]) == tree.levels[-1].n[cells].sum()
    assert len(tree.hold(cells[: len(cells) // 4])) == 0
    for cell in np.flatnonzero(tree.spans[:, 0] >= 0):
        mine = tree.held[slice(*tree.spans[cell])]
        assert len(mine) == tree.levels[-1].n[cell]
        assert (mine >= tree.levels[-1].low[cell]).all() and (mine <= tree.levels[-1].high[cell]).all()


def test_sums_of_distances_take_few_calls(monkeypatch):
    """Sources that lie near many boxes are met in one piece; each pair of boxes used to be a call of its own."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, (5000, 2)), rng.exponential(3, (4000, 2)), np.tile([[0.5, 0.5]], (1000, 1))])
    weights = np.eye(3)[rng.integers(0, 3, len(x))]
    exact, calls = celltree._direct(x, x, weights), []
    plain = celltree._direct
    monkeypatch.setattr(celltree, "_direct", lambda t, s, w: calls.append(1) or plain(t, s, w))
    found = celltree.distance_sums(x, x, weights)
    assert np.abs(found / exact - 1).max() < 3e-8
    assert len(calls) < len(x) / 15


def test_starting_centres_of_ties_and_missing_keys(spark):
    """Of equally far rows the least key is taken, one without a key last."""
    rows = [(7, 0.0, 0.0), (5, 9.0, 0.0), (3, -9.0, 0.0), (None, 0.0, 9.0), (4, 0.0, -9.0)]
    frame = spark.createDataFrame(rows, "id long, x double, y double").repartition(3)
    start = cluster.starting_centres_all(frame.where("id = 7 OR id IS NULL"), ["x", "y"], "id", 2, [1, 2])
    assert [sorted(map(tuple, s)) for s in start] == [[(0.0, 0.0), (0.0, 9.0)]] * 2
    for first, *others in cluster.starting_centres_all(frame.where("id IS NOT NULL"), ["x", "y"], "id", 4, range(6)):
        seen = [tuple(first)]
        for centre in others:
            gap = {r: min(sum((a - b) ** 2 for a, b in zip(r[1:], c)) for c in seen) for r in rows if r[0] is not None}
            assert tuple(centre) == min(gap, key=lambda r: (-gap[r], r[0]))[1:]
            seen.append(tuple(centre))


def test_rows_of_a_fit_with_many_borders_are_read_once(spark):
    """400,000 rows and borders nearly everywhere, as with the restarts of two groups of customers: no job per update."""
    spread = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000003)) / 1000003.0).alias(c) for i, c in enumerate("xy")]
    frame = spark.range(400_000).select("id", *spread)
    tree = CellTree.build(frame, ["x", "y"])
    models = [np.random.default_rng(seed).random((6, 2)) for seed in range(40)]
    for _ in range(2):
        models, _ = tree.update(models)
    assert tree.rows_read <= 400_000
