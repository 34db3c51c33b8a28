"""Connected components of a table of links, by union-find in partitions and star steps between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterflow.llm.tables import Workspace

STARS = "a long, b long"


def _forest(batches):
    """Join the links of a partition: every node with the smallest node it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.array(nodes, np.int64)), pa.array(np.array([root(x) for x in nodes], np.int64))],
        names=["a", "b"])


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step; links point from the larger node to the smaller."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("n"), F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(
        F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    small = large.join(down, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.filter("a <> b").unionAll(down.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def components(space: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(node, root): each linked node and the smallest node it can reach; roots are not listed.

    `links` has two long columns; order, repeats and loops don't matter, nulls are left out.
    No links give no rows. The result is a table in the folder `name` of the workspace.
    """
    a, b = (F.col(c) for c in links.columns)
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b")
    now = space.keep(now.mapInArrow(_forest, STARS), f"{name}/0")
    seen, turn = None, 0
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] == 0 or state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, turn = state, turn + 1
        now = space.keep(_stars(now), f"{name}/{turn}")
        space.remove(f"{name}/{turn - 1}")
