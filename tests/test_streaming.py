"""Streams in several batches give the batch result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bazarlens.operators import recommend
from bazarlens.session import fresh_path
from bazarlens.streaming import complaints as stream_complaints
from bazarlens.streaming import events as stream


@pytest.fixture(scope="module")
def landing(spark):
    """Events in three files, in time order, with one hot customer."""
    rng = np.random.default_rng(0)
    n = 900
    pdf = pd.DataFrame({
        "event_id": np.arange(n),
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 5 * 86_400, n)), unit="s"),
        "user_id": np.where(rng.random(n) < 0.34, 7, rng.integers(0, 20, n)),
        "event_type": rng.choice(["view", "click", "purchase", "error"], n),
        "value": 1.0,
        "props": [f'{{"k": {k}}}' for k in rng.integers(0, 4, n)],
    })
    path = fresh_path(spark, "landing")
    for i in range(3):
        part = spark.createDataFrame(pdf.iloc[i * 300 : (i + 1) * 300])
        part = part.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        part.coalesce(1).write.mode("append").parquet(path)
    pdf["product_id"] = pdf["props"].str.extract(r"(\d+)").astype(int)
    return path, pdf


def read(spark, path):
    return stream.read_events(spark, path, "*.parquet", files_per_batch=1)


@pytest.mark.parametrize("compact_every", [1, 2, 20])
def test_counts_of_all_windows(spark, landing, compact_every):
    path, pdf = landing
    keys = ["window_start", "customer_id", "event_type"]
    got = stream.run_update(stream.event_counts(read(spark, path)), keys, *stream.scratch(spark, "t"), compact_every)
    want = pdf.groupby([pdf.ts.dt.floor("D"), "user_id", "event_type"]).size()
    assert {(r["window_start"], r["customer_id"], r["event_type"]): r["n"] for r in got.collect()} == {
        (k[0].to_pydatetime(), k[1], k[2]): v for k, v in want.items()
    }


def test_running_scores_equal_batch(spark, landing):
    path, _ = landing
    weights = {"purchase": 1.0, "click": 0.25, "view": 0.125}
    got = stream.run_update(stream.implicit_scores(read(spark, path), weights), ["customer_id", "product_id"], *stream.scratch(spark, "t"))
    batch = spark.read.parquet(path).select(
        F.col("user_id").alias("customer_id"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("product_id")
    )
    want = recommend.implicit_weights(batch, weights)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def in_two_runs(spark, path, pdf, stateful):
    """(rows after the files, rows after a heartbeat); the second run goes on from the checkpoint of the first."""
    target, checkpoint, pulse = *stream.scratch(spark, "t"), fresh_path(spark, "pulse")
    stream.beat(spark, pulse)
    run = lambda: stream.run_append(stateful(stream.with_heartbeats(read(spark, path), pulse)), target, checkpoint).collect()
    first = run()
    stream.beat(spark, pulse, spark.createDataFrame(pd.DataFrame({"ts": [pdf.ts.max() + pd.Timedelta(days=30)]})))
    return first, run()


def test_sessions(spark, landing):
    path, pdf = landing
    closed, got = in_two_runs(spark, path, pdf, lambda events: stream.sessions(events, "2 hours"))
    assert 0 < len(closed) < len(got)
    want = set()
    for customer, rows in pdf.groupby("user_id"):
        ts = rows.ts.sort_values()
        for _, visit in ts.groupby((ts.diff() >= pd.Timedelta(hours=2)).cumsum()):
            want.add((customer, visit.min().to_pydatetime(), len(visit), (visit.max() - visit.min()).total_seconds()))
    rows = [(r["customer_id"], r["session_start"], r["n_events"], r["dwell_seconds"]) for r in got]
    assert set(rows) == want and len(rows) == len(want)


def test_repeated_events_are_kept_once(spark, landing):
    path, pdf = landing
    twice = read(spark, path).unionByName(read(spark, path))
    got = stream.run_append(stream.deduplicate(twice), *stream.scratch(spark, "t"))
    assert sorted(r["event_id"] for r in got.collect()) == list(pdf.event_id)


def answers(events, within="3 hours"):
    served = events.filter(F.col("event_type").isin("view", stream.HEARTBEAT))
    return stream.first_actions(served, events.filter("event_type IN ('click', 'purchase')"), within)


def test_first_action_of_every_served_row(spark, landing):
    """Each served row comes out once, over three files, a restart and a heartbeat."""
    path, pdf = landing
    early, got = in_two_runs(spark, path, pdf, answers)
    want = {}
    acts = pdf[pdf.event_type.isin(["click", "purchase"])]
    for _, s in pdf[pdf.event_type == "view"].iterrows():
        later = acts[(acts.user_id == s.user_id) & (acts.product_id == s.product_id) & (acts.ts > s.ts) & (acts.ts <= s.ts + pd.Timedelta(hours=3))]
        want[s.event_id] = later.sort_values(["ts", "event_id"]).iloc[0].event_type if len(later) else None
    assert 0 < len(early) < len(got) == len(want)
    assert {r["served_id"]: r["action"] for r in got} == want
    assert any(want.values()) and None in want.values()


def test_servings_and_actions_wait_as_long_as_they_must():
    views, acts = [(100, 1), (150, 2), (400, 3)], [(90, 7, "click"), (160, 8, "click"), (160, 9, "purchase"), (500, 10, "purchase")]
    # Time 120: an action before 160 may still come.
    final, waiting, kept, wake = stream._settle(views, acts, 120, 200)
    assert (final, waiting, wake) == ([], views, 160) and kept == acts[1:]
    final, waiting, kept, wake = stream._settle(views, acts, 160, 200)
    assert final == [(1, acts[1]), (2, acts[1])] and waiting == [(400, 3)] and kept == [acts[3]] and wake == 500
    final, waiting, kept, wake = stream._settle(waiting, kept, 10_000, 50)
    assert (final, waiting, kept, wake) == ([(3, None)], [], [], None)


def test_feedback_without_customer_or_product(spark):
    path = fresh_path(spark, "landing")
    rows = [(1, 5, "view", None), (2, 5, "click", None), (3, None, "view", 1), (4, None, "click", 1), (5, 6, "view", 1), (6, 6, "click", 1), (7, 6, "purchase", 1)]
    frame = spark.createDataFrame([(i, (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i if i < 7 else 6)).to_pydatetime(), c, t, 1.0, f'{{"k": {p}}}' if p else "{}") for i, c, t, p in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(path)
    _, got = in_two_runs(spark, path, pd.DataFrame({"ts": [pd.Timestamp("2024-01-01")]}), answers)
    assert sorted((r["served_id"], r["customer_id"], r["product_id"], r["action"]) for r in got) == [(1, 5, None, None), (3, None, 1, None), (5, 6, 1, "click")]


def test_answers_at_the_edges_of_a_window(spark):
    """An action the whole window later counts, a microsecond more does not; a row without a time meets nothing."""
    path, edge = fresh_path(spark, "landing"), pd.Timestamp("2024-01-01 03:00:00")
    tick, width = pd.Timedelta(microseconds=1), pd.Timedelta(hours=3)
    rows = [(1, edge - tick, 5, "view"), (2, edge - tick + width, 5, "click"), (3, edge, 6, "view"), (4, edge + width + tick, 6, "click"), (5, edge, 6, "click")]
    rows += [(6, edge, 7, "view"), (7, edge - tick, 7, "click"), (8, edge + tick, 7, "purchase"), (9, None, 7, "view"), (10, None, 7, "click")]
    frame = spark.createDataFrame([(i, t and t.to_pydatetime(), c, kind, 1.0, '{"k": 1}') for i, t, c, kind in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.coalesce(1).write.parquet(path)
    _, got = in_two_runs(spark, path, pd.DataFrame({"ts": [edge]}), answers)
    assert sorted((r["served_id"], r["action"], r["action_ts"]) for r in got) == [
        (1, "click", (edge - tick + width).to_pydatetime()), (3, None, None), (6, "purchase", (edge + tick).to_pydatetime()), (9, None, None)
    ]


def test_no_python_call_for_a_key(spark, landing):
    """State is held by Spark's aggregate: a Python call for each (customer, product) took longer than all the rest."""
    plan = answers(read(spark, landing[0]))._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "FlatMapGroups" not in plan and "TransformWithState" not in plan


def test_one_key_with_many_rows_is_settled_in_order():
    """Neither servings nor actions are gone through for each other."""
    n = 30_000
    views, acts = [(10 * i, i) for i in range(n)], [(10 * i + 5, n + i, "click") for i in range(n)]
    final, waiting, kept, wake = stream._settle(views, acts, 10 * n, 4)
    assert (final, waiting, kept, wake) == ([(i, None) for i in range(n)], [], [], None)
    final, waiting, kept, wake = stream._settle(views, acts, 50, 7)
    assert final == [(i, acts[i]) for i in range(5)] and waiting == views[5:] and kept == acts[5:] and wake == 55


def test_new_review_files_are_classified_once(spark):
    path = fresh_path(spark, "reviews")
    schema = "review_id string, order_id string, review_score int, review_comment_message string"
    spark.createDataFrame([("r1", "o1", 1, "nao recebi"), ("r2", "o2", 5, "bom")], schema).write.parquet(path)
    target, checkpoint = stream.scratch(spark, "t")

    def run():
        source = stream_complaints.read_reviews(spark, path, spark.read.parquet(path).schema, "*.parquet")
        done = stream_complaints.classify_stream(source, target, checkpoint)
        return sorted((r["review_id"], r["pain_point_category"]) for r in done.collect())

    assert run() == [("r1", "Logistica_Retrasos")]
    assert run() == [("r1", "Logistica_Retrasos")]
    spark.createDataFrame([("r3", "o3", 2, "produto quebrado")], schema).write.mode("append").parquet(path)
    assert run() == [("r1", "Logistica_Retrasos"), ("r3", "Calidad_Producto")]
