"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import cut, drop
from tensorloom.llm.tokens import lean

LINKS = "a long, b long"


def find(parent: dict, x):
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while (up := parent.get(x, x)) != root:
        parent[x], x = root, up
    return root


MOST = 200_000  # links that a task holds


def _forest(batches, most: int = MOST):
    """Links of a partition as links to the smallest node of each local tree; the table in memory stays below `most` links."""
    parent: dict[int, int] = {}

    def flush():
        rows = [(x, r) for x in parent if (r := find(parent, x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ra, rb = find(parent, a), find(parent, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                if len(parent) >= most:
                    yield flush()
                    parent.clear()
    if parent:
        yield flush()


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of links (a, b) the smallest node that it reaches.

    Each partition first replaces its links by a forest. Then large-star and small-star steps alternate until the links no
    longer change: a step takes the smallest neighbour of each node (a sum with map-side combine) and joins it back (a
    sort-merge join, which adaptive execution splits where a node is hot). Rounds grow with the logarithm of the longest
    path. Once at most MOST links are left, one task unites them. Links to oneself and repeated links do no harm; nulls are dropped; no links give no rows.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = cut(links.mapInArrow(lean(_forest), LINKS).distinct(), "links")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    before = now.agg(mark).first()[0]
    while before[0] > MOST:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least).distinct()
        # after the partitions' own work few rows are left to contract
        after = cut(small.mapInArrow(lean(_forest), LINKS).distinct(), "links")
        drop(now)
        now, mark_now = after, after.agg(mark).first()[0]
        if mark_now == before:
            break
        before = mark_now
    if 0 < before[0] <= MOST:
        now = now.coalesce(1).mapInArrow(lean(_forest), LINKS)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
