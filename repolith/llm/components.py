"""Connected components of links, as tables, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm import shared

SALTS = 16


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as stars around the least node of each local component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    stars = [(x, root(x)) for x in list(parent) if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in stars], pa.int64()), pa.array([s[1] for s in stars], pa.int64())], ["a", "b"])


def _are_stars(links: DataFrame) -> bool:
    """No node has two links up, or links both up and from below."""
    up = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    return up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def _with_least(links: DataFrame) -> DataFrame:
    """``links`` with m, the least of a and its neighbours. Hubs are dealt over salts, so none is one task."""
    least = links.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(least, ["a", "salt"]).drop("salt")


def connected_components(links: DataFrame, most_rounds: int = 40, rows_per_task: int = 200_000) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the least node that links reach.

    Tasks first contract up to ``rows_per_task`` links each. Rounds of large and small stars follow until only stars are
    left (logarithmic in the longest path); each round's links are written to the shared folder. Nodes without links
    are not listed.
    """
    links = shared.written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    tasks = max(1, -(-links.count() // rows_per_task))
    links = shared.written(links.coalesce(tasks).mapInArrow(_local_stars, "a long, b long"), "links")
    for _ in range(most_rounds):
        # One task has settled all.
        if tasks == 1 or _are_stars(links):
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        near = _with_least(down)
        small = near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
        links = shared.written(small.filter("a <> b").distinct(), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
