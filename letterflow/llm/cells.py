"""Groups of rows that share buckets, verified in bounded cells and joined by union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterflow.llm.components import STARS, components
from letterflow.llm.tables import Workspace

#: Rows held at once in a cell of comparisons, and rows that pass by them.
BLOCK, SALT = 256, 2048

#: What a row is in its cell: held there, held and compared with the others, compared as it passes by.
HELD, BOTH, PASSING = 0, 1, 2


class _Cell:
    """The held rows of a cell, ready to be compared."""

    def __init__(self, kind):
        self.kind = kind
        self.rows: list[tuple[int, int, int, bytes]] = []
        self.held = None

    def links(self, own: int, root: int, content: bytes) -> list[tuple[int, int]]:
        """Links with held rows of other roots: one for each such root."""
        if self.held is None:
            ids, roots, _, contents = zip(*self.rows)
            self.held = np.array(ids), np.array(roots), self.kind(contents)
        ids, roots, held = self.held
        good = held.near(content) & (roots != root)
        return [(own, int(ids[k])) for k in np.flatnonzero(good)[np.unique(roots[good], return_index=True)[1]]]

    def close(self) -> list[tuple[int, int]]:
        return [link for own, root, role, x in self.rows if role == BOTH for link in self.links(own, root, x)]


def _linker(kind):
    def linked(batches):
        """Links found in the cells of a partition; rows come sorted by cell, held ones first.

        A cell holds a bounded number of rows; others pass by one at a time.
        """
        place, cell = None, _Cell(kind)
        for batch in batches:
            found = []
            places = zip(*(batch.column(c).to_pylist() for c in ("key", "block", "salt")))
            ids, roots, roles = (batch.column(c).to_pylist() for c in ("id", "root", "role"))
            contents = batch.column("content")
            for i, own in enumerate(places):
                if own != place:
                    found += cell.close()
                    place, cell = own, _Cell(kind)
                content = contents[i].as_py()
                if roles[i] != PASSING:
                    cell.rows.append((ids[i], roots[i], roles[i], content))
                elif cell.rows:
                    found += cell.links(ids[i], roots[i], content)
            yield _as_links(found)
        yield _as_links(cell.close())

    return linked


def _as_links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compare(rows: DataFrame, contents: DataFrame, kind) -> DataFrame:
    """Links between rows of the same key that have other roots.

    rows: (key, id, root, held, compared). The held rows of a key are dealt into blocks, the compared
    ones into salts if they are many; each block meets each salt in a cell of its own, so no task
    holds a whole key. In a key of one cell a row goes there once.
    """
    dealt = rows.groupBy("key").agg(
        F.greatest(F.ceil(F.sum(F.col("held").cast("long")) / BLOCK), F.lit(1)).alias("blocks"),
        F.greatest(F.ceil(F.sum(F.col("compared").cast("long")) / SALT), F.lit(1)).alias("salts"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    placed = rows.join(dealt, "key")
    one, more = placed.filter("blocks = 1 and salts = 1"), placed.filter("blocks > 1 or salts > 1")
    role = F.when(~F.col("held"), PASSING).when(F.col("compared"), BOTH).otherwise(HELD)
    none = F.lit(0).cast("long")
    cells = one.select("key", none.alias("block"), none.alias("salt"), "id", "root", role.alias("role")).unionAll(
        more.filter("held").select(
            "key", own("blocks").alias("block"), spread("salts").alias("salt"), "id", "root",
            F.lit(HELD).alias("role"))).unionAll(
        more.filter("compared").select(
            "key", spread("blocks").alias("block"), own("salts").alias("salt"), "id", "root",
            F.lit(PASSING).alias("role")))
    return (cells.join(contents, "id")
            .repartition("key", "block", "salt")
            .sortWithinPartitions("key", "block", "salt", "role", "id")
            .select("key", "block", "salt", "id", "root", "role", "content")
            .mapInArrow(_linker(kind), STARS))


def grouped(space: Workspace, shared: DataFrame, contents: DataFrame, kind) -> DataFrame:
    """(node, root) of the rows linked with others: root is the smallest id reachable.

    shared: (bucket, id, hub) of all rows in buckets of two and more, hub being one of the bucket's
    rows. contents: (id, content), binary. kind(contents of held rows) has a method near(content): which
    of them it is linked with.

    First all rows of a bucket are compared with its hub. Where components still meet in a bucket,
    all rows outside its most frequent one are then compared with the whole bucket, in blocks within
    tasks. So no link between rows of one bucket is lost, pairs are never written out, and in a group
    of copies only the few that the hubs did not link are compared with all. The workspace keeps
    the result alone.
    """
    yes, no = F.lit(True), F.lit(False)
    pairs = space.keep(shared.filter("id <> hub").select(F.col("hub").alias("key"), "id").distinct(), "pairs")
    around = pairs.select("key", "id", F.col("id").alias("root"), no.alias("held"), yes.alias("compared"))
    hubs = pairs.select("key").distinct().select(
        "key", F.col("key").alias("id"), F.col("key").alias("root"), yes.alias("held"), no.alias("compared"))
    links = space.keep(_compare(hubs.unionAll(around), contents, kind), "links")
    roots = components(space, links, "first")
    rest = space.keep(_compare(_open(shared, roots), contents, kind), "rest")
    last = components(space, links.unionAll(rest), "last")
    for done in ("pairs", "links", "rest", "first"):
        space.remove(done)
    return last


def buckets(banded: DataFrame) -> DataFrame:
    """(bucket, id, hub) of the buckets with more than one row; the hub is chosen by hash.

    banded: (bucket, id). A pair may stand there more than once.
    """
    hubs = banded.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", "bucket"), "id")).alias("hub")
    ).filter("n > 1").select("bucket", F.col("hub.id").alias("hub"))
    return banded.join(hubs, "bucket").select("bucket", "id", "hub")


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows still to be compared: those of the buckets in which more than one component meets.

    All are held; those outside the bucket's most frequent component are compared with all others.
    """
    placed = shared.select("bucket", "id").join(roots, F.col("id") == F.col("node"), "left").select(
        "bucket", "id", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(
        F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    return placed.join(mixed, "bucket").select(
        F.col("bucket").alias("key"), "id", "root", F.lit(True).alias("held"),
        (F.col("root") != F.col("main.root")).alias("compared"))
