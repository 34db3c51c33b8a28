"""Shards of equal bytes by k-d tree: split at weighted medians along the widest metadata dimension."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterflow.llm.tables import Workspace, numbered, running_total, utf8_bytes

#: Each dimension is laid on a grid of so many cells from its smallest to its largest value.
GRID = 1 << 20
#: Bins of one step of the search for a median.
BINS = 1024
#: A median is near enough if what cannot be divided further by it is this share of a leaf.
TOLERANCE = 1 / 4096
#: Leaves there may be: the driver holds one split for each.
LEAVES = 1 << 17


@dataclass
class _Node:
    """A box still to be split into `leaves` leaves, the first of them number `first`."""

    first: int
    leaves: int
    weight: float
    dim: int
    low: int
    high: int
    below: float = 0.0
    edge: int | None = None

    @property
    def target(self) -> float:
        return self.weight * (self.leaves // 2) / self.leaves


def document_size(text: Column) -> Column:
    """Bytes a text takes in a shard: its UTF-8 bytes (null: none) and 8 more."""
    return utf8_bytes(text) + 8


def name_axis(name: Column) -> Column:
    """A place on an axis for a name: equal names lie together, which are near means nothing."""
    return F.crc32(name.cast("string"))


def kd_shards(docs: DataFrame, size: Column, dimensions: list[Column], shards: int | None = None,
              target_bytes: int | None = None, space: Workspace | None = None,
              together: Column | None = None) -> DataFrame:
    """All columns of docs plus size, shard and slot (from 0, without gaps in a shard).

    Give the number of shards, or the bytes of one: the number is then all bytes over it, rounded up.
    A box of k leaves is split along its widest dimension (of the share of the whole range, first of
    equals), in floor(k / 2) to ceil(k / 2) of its bytes, until every box is one leaf. Rows with the
    same place on that dimension stand in the order of `together`'s hash and then of the table: rows
    with an equal value of it and equal dimensions lie side by side, so that a split cuts at most one group
    of them, and any number of equal rows is still split evenly. Shards differ by the largest row
    and 1/4096 of a shard for each level.

    Medians are searched in histograms that executors sum; each step narrows every box's range to one
    bin, and only one row for each box comes to the driver. Null dimensions count as the smallest
    value. Columns named size, shard or slot are replaced. An empty table has no rows.
    """
    space = space or Workspace(docs.sparkSession, "kd-shards")
    lead = "_"
    while any(c.lower().startswith(lead) for c in docs.columns):
        lead += "_"
    names, rid, at, group = [f"{lead}d{k}" for k in range(len(dimensions))], f"{lead}rid", f"{lead}place", f"{lead}group"
    own = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    base = docs.select(
        *[docs[c] for c in own], size.cast("long").alias("size"),
        *[d.cast("long").alias(n) for d, n in zip(dimensions, names)],
        F.monotonically_increasing_id().alias(rid),
        (F.lit(0).cast("long") if together is None else F.xxhash64(together)).alias(group))
    base = space.keep(base, "rows")
    part = F.shiftright(rid, 33)
    stats = base.agg(
        F.sum("size").alias("size"), F.count("*").alias("rows"), *[f(n).alias(f"{f.__name__}{n}") for n in names for f in (F.min, F.max)]).first()
    if stats["size"] is None:
        none = F.lit(None).cast("int")
        return base.select(*own, "size", none.alias("shard"), none.cast("long").alias("slot"))
    shards = shards or max(1, -(-stats["size"] // target_bytes))
    if shards > LEAVES:
        raise ValueError(f"more than {LEAVES} shards")
    places = stats["rows"]

    def cell(n: str) -> Column:
        low, high = stats[f"min{n}"], stats[f"max{n}"]
        if low is None or low == high:
            return F.lit(0).cast("long")
        share = (F.coalesce(F.col(n), F.lit(low)) - F.lit(low)).cast("double") / float(high - low)
        return F.floor(share * (GRID - 1)).cast("long")

    places_of = numbered(space, base.select(rid, "size", group, *names), None, [group, rid], "places", count="of")
    placed = places_of.select(
        rid, "size", F.col("rank").alias("place"), *[cell(n).alias(n) for n in names], F.lit(0).alias("node"))
    open_ = [(0, shards)] if shards > 1 else []
    level = 0
    while open_:
        placed = space.keep(placed, f"level-{level}")
        space.remove(f"level-{level - 1}" if level else "places")
        nodes = _widest(placed, names, open_, places)
        _find_medians(placed, names, nodes, stats["size"] / shards, places)
        placed = _split(placed, names, nodes, places)
        open_ = [x for n in nodes for x in (
            (n.first, n.leaves // 2), (n.first + n.leaves // 2, n.leaves - n.leaves // 2)) if x[1] > 1]
        level += 1
    leaf = space.keep(placed.select(rid, F.col("node").cast("int").alias("shard")), "leaves")
    space.remove(f"level-{level - 1}" if level else "places")
    slots = running_total(
        leaf.withColumn("_part", part).withColumn("_one", F.lit(1).cast("long")), "_one", ["shard"], "_part",
        [F.col(rid)], "slot").select(F.col(rid).alias(at), "shard", "slot")
    return base.join(slots, F.col(rid) == F.col(at)).select(*own, "size", "shard", "slot")


def _table(placed: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A row for each open box, broadcast: at most LEAVES of them. A literal, which no Python worker makes."""
    names = [field.split()[0] for field in schema.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    kind = f"array<struct<{', '.join(field.replace(' ', ': ') for field in schema.split(', '))}>>"
    return F.broadcast(placed.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), kind))))


def _key(names: list[str], places: int) -> Column:
    """Place of a row along its box's dimension; rows on the same cell follow in table order."""
    axis = F.coalesce(*[F.when(F.col("dim") == k, F.col(n)) for k, n in enumerate(names)], F.lit(0).cast("long"))
    return axis * F.lit(places) + F.col("place")


def _widest(placed: DataFrame, names: list[str], open_: list[tuple[int, int]], places: int) -> list[_Node]:
    boxes = _table(placed, open_, "node int, leaves int")
    rows = placed.join(boxes, "node").groupBy("node", "leaves").agg(
        F.sum("size").alias("weight"), *[f(n).alias(f"{f.__name__}{n}") for n in names for f in (F.min, F.max)]
    ).collect()
    out = []
    for r in rows:
        width = [r[f"max{n}"] - r[f"min{n}"] for n in names] or [0]
        dim = width.index(max(width))
        low, high = (r[f"min{names[dim]}"], r[f"max{names[dim]}"]) if names else (0, 0)
        out.append(_Node(r["node"], r["leaves"], float(r["weight"]), dim, low * places, (high + 1) * places))
    return out


def _find_medians(placed: DataFrame, names: list[str], nodes: list[_Node], leaf: float, places: int) -> None:
    """Set each box's edge: the place along its dimension below which its first half lies."""
    todo = nodes
    while todo:
        boxes = _table(placed, [
            (n.first, n.dim, n.low, max(1, -(-(n.high - n.low) // BINS)), n.high, n.target - n.below) for n in todo],
            "node int, dim int, low long, step long, high long, want double")
        key = placed.join(boxes, "node").withColumn("key", _key(names, places)).filter("key >= low and key < high")
        bins = key.groupBy("node", "want", F.floor((F.col("key") - F.col("low")) / F.col("step")).alias("bin")).agg(
            F.sum("size").alias("held"))
        upto = F.sum("held").over(Window.partitionBy("node").orderBy("bin"))
        found = {r["node"]: r for r in bins.withColumn("upto", upto).filter(
            "upto >= want and upto - held < want").collect()}
        rest = []
        for n in todo:
            step = max(1, -(-(n.high - n.low) // BINS))
            r = found.get(n.first)
            if r is None:  # nothing is wanted below
                n.edge = n.low
                continue
            low = n.low + r["bin"] * step
            before, after = n.below + r["upto"] - r["held"], n.below + r["upto"]
            if step == 1 or r["held"] <= TOLERANCE * leaf:
                n.edge = low if n.target - before < after - n.target else low + step
            else:
                n.low, n.high, n.below = low, min(low + step, n.high), before
                rest.append(n)
        todo = rest


def _split(placed: DataFrame, names: list[str], nodes: list[_Node], places: int) -> DataFrame:
    edges = _table(placed, [(n.first, n.dim, n.edge, n.first + n.leaves // 2) for n in nodes],
                   "node int, dim int, edge long, right int")
    return placed.join(edges, "node", "left").select(
        *[c for c in placed.columns if c != "node"],
        F.when(_key(names, places) >= F.col("edge"), F.col("right")).otherwise(F.col("node")).alias("node"))


def document_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
                    space: Workspace | None = None) -> DataFrame:
    """Shards of documents: their metadata are size, language and source; copies of a text lie side by side.

    All columns stay, but for size, shard and slot. A null text has no bytes and counts 8, like an empty one;
    a null lang or source is the smallest. Repeated rows are rows of their own. An empty table has no rows.
    """
    return kd_shards(
        docs, document_size(F.col("text")),
        [document_size(F.col("text")), name_axis(F.col("lang")), name_axis(F.col("source"))],
        shards, target_bytes, space, F.coalesce(F.col("text").cast("string"), F.lit("")))
