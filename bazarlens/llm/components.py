"""Connected components of a distributed list of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from bazarlens.session import materialize


# So many links, some 16 MB, are joined up by one task.
FEW_LINKS = 1 << 20


def _join_up(links: DataFrame) -> DataFrame:
    """(node, component) of few links, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while above.setdefault(top, top) != top:
                top = above[top]
            while above[x] != top:
                above[x], x = top, above[x]
            return top

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                above[max(a, b)] = min(a, b)
        nodes = list(above)
        for start in range(0, len(nodes), 100_000):
            some = nodes[start : start + 100_000]
            yield pa.record_batch([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["node", "component"])

    return links.coalesce(1).mapInArrow(run, "node long, component long")


def _larger_side(links: DataFrame) -> DataFrame:
    """Every node hands the least of its neighbourhood to its larger neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _smaller_side(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    tied = links.join(least, "u").where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return tied.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def connected_components(links: DataFrame, few_links: int = FEW_LINKS) -> DataFrame:
    """(node, component): the least node reachable, for every node that has a link.

    ``links`` has two long columns ``u`` and ``v``; rows may repeat, point
    either way or from a node to itself; rows with a null are no links. Stars
    are contracted until nothing changes, in about as many rounds as the
    logarithm of the longest path, or until so few links are left that one task can join
    them up, whichever is first. Each round is a written table.
    """
    links = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    contracted = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen = None
    while True:
        # What a round ends with is noted while it is written.
        state = Observation()
        links = materialize(contracted.observe(state, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), "links")
        now = (state.get["n"], state.get["s"])
        if now[0] <= few_links:
            return _join_up(links)
        if now == seen:
            break
        seen, contracted = now, _smaller_side(_larger_side(links))
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
