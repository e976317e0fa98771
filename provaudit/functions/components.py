"""Connected components of a graph given as links (a, b) of strings, in few rounds.

Links contract inside partitions first: a partition keeps one link a node, to the smallest node it is joined to there. Then each
round lets every node point at its smallest neighbour (large-star, then small-star), is written to the shared folder, and
contracts again, so long chains shrink by far more than half a round. Once few links are left, one task joins them. Counts and
minima of a node are taken by aggregation, and joins are plain shuffles on both sides, which Spark splits where a node has very many links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provaudit.plans.storage import written

#: Links that one task joins, and nodes that a task holds before it passes its links on.
LAST = 200_000
HELD = 500_000


def contracted(links: DataFrame) -> DataFrame:
    """The same components: within each partition every node with one link, to the smallest node it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[str, str] = {}

        def top(x: str) -> str:
            path = []
            while (y := above.get(x, x)) != x:
                path.append(x)
                x = y
            for p in path:
                above[p] = x
            return x

        def out() -> pa.RecordBatch:
            pairs = [(top(x), x) for x in list(above)]
            pairs = [p for p in pairs if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, high = sorted((top(a), top(b)))
                above.setdefault(low, low)
                above[high] = low
            if len(above) > HELD:
                yield out()
                above.clear()
        yield out()

    return links.select("a", "b").mapInArrow(run, "a string, b string")


def components(links: DataFrame, last: int = LAST) -> tuple[DataFrame, int]:
    """((node, root), rounds): the smallest node of its component for every node that has a link to another."""
    now, rounds = written(contracted(links.where("a <> b")), "links"), 0
    while now.count() > last:
        rounds += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), "large-star")
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b")
        star = small.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").unionByName(small.select(F.col("m").alias("a"), "b")).distinct()
        done = star.join(star.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()  # no root is a member
        now = written(star if done else contracted(star), "links")
        if done:
            break
    else:
        now = written(contracted(now.coalesce(1)), "links")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()), rounds
