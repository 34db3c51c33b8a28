"""A Merkle manifest of a table as a postorder append log, and proofs read from it by position."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterflow.llm.tables import Workspace, numbered

#: A builder makes a subtree of 2 ** SPAN aligned nodes; the next stage's builders go on from these.
SPAN = 10
#: What a row is to the reader of a segment: the way from its top to the root, a node, a row to prove.
WAY, NODE, ROW = 0, 1, 2
#: A step of a proof: one byte for the sibling's side (none, left, right) and its digest.
NONE, LEFT, RIGHT = b"\0", b"\1", b"\2"
STEP = 33

NODES = "tree string, n long, block long, height int, at long, pos long, digest binary"


def encoded(value: Column) -> Column:
    """A value as part of what is hashed: `-` if null, else its UTF-8 bytes' count, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def tree_height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves in which every two nodes, or a last one alone, make one."""
    return max(n - 1, 0).bit_length()


def subtree_size(height: int, leaves: int) -> int:
    """Nodes of a subtree of a height with so many leaves, the single ones above its right edge included."""
    return sum(-(-leaves >> h) for h in range(height + 1))


def position(height: int, at: int, n: int) -> int:
    """Place of node `at` of a height in the log of a tree of n leaves.

    Before its first leaf s the log holds all complete subtrees of s leaves, 2 s less one for each bit
    of s; then comes its own subtree, itself last.
    """
    first = at << height
    return 2 * first - first.bit_count() + subtree_size(height, min(1 << height, n - first)) - 1


def parent(*children: bytes) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


class _Builder:
    """Writes the nodes of aligned subtrees as they are completed; holds one open node for each level."""

    def __init__(self, base: int, span: int):
        self.base, self.span = base, span
        self.own, self.n, self.count, self.open = None, 0, 0, {}
        self.out: list[tuple] = []

    def _write(self, height: int, at: int, digest: bytes) -> None:
        tree, block = self.own
        self.out.append((tree, self.n, block, self.base + height, at,
                         position(self.base + height, at, self.n), digest))

    def add(self, tree, block: int, n: int, at: int, digest: bytes) -> None:
        if (tree, block) != self.own:
            self.close()
            self.own, self.n = (tree, block), n
        self.count += 1
        self._write(0, at, digest)
        height = 0
        while height in self.open:
            digest, height, at = parent(self.open.pop(height), digest), height + 1, at >> 1
            self._write(height, at, digest)
        self.open[height] = digest

    def close(self) -> None:
        """Complete the right edge: up to the whole subtree's height, or until one node is left of the tree."""
        if self.count:
            whole = tree_height(self.n) - self.base
            top, last, carried = min(self.span, whole), None, False
            first = self.own[1] << self.span
            for height in range(top):
                held = self.open.pop(height, None)
                if held is not None:
                    last, carried = (parent(held, last) if carried else parent(held)), True
                elif carried:
                    last = parent(last)
                if carried:
                    self._write(height + 1, (first + self.count - 1) >> (height + 1), last)
        self.own, self.count, self.open = None, 0, {}

    def written(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) if self.out else [()] * 7
        self.out = []
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["tree", "n", "block", "height", "at", "pos", "digest"])


def _built(base: int, span: int):
    def build(batches):
        builder = _Builder(base, span)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "at", "digest"))):
                builder.add(*row)
            yield builder.written()
        builder.close()
        yield builder.written()

    return build


@dataclass
class Manifest:
    """The log in stages (each SPAN levels of all trees) and the trees' roots (tree, n, digest)."""

    stages: list[DataFrame]
    roots: DataFrame
    span: int

    @property
    def log(self) -> DataFrame:
        """tree, n, height, at, pos, digest of every node, once; `pos` is its place in its tree's log."""
        out = self.stages[0]
        for k, stage in enumerate(self.stages[1:], 1):
            out = out.unionAll(stage.filter(F.col("height") > k * self.span))
        return out.drop("block")


def build(space: Workspace, leaves: DataFrame, name: str = "log", span: int | None = None) -> Manifest:
    """The log of one tree for each `tree`.

    leaves: tree string, n (leaves of the tree), at (from 0 without gaps), digest binary. Every two
    consecutive nodes, the last one alone if their number is odd, become the digest of their digests'
    hex texts until one is left; a lone leaf is its own root.

    A task builds aligned subtrees of 2 ** span nodes, so no tree meets in one task; their tops are
    the leaves of the next stage. No rows give no trees.
    """
    span = span or SPAN
    now, stages, roots = leaves.select("tree", "n", "at", "digest"), [], None
    while True:
        base = len(stages) * span
        blocks = now.withColumn("block", F.shiftright("at", span)).repartition("tree", "block").sortWithinPartitions(
            "tree", "block", "at").select("tree", "block", "n", "at", "digest")
        stage = space.keep(blocks.mapInArrow(_built(base, span), NODES), f"{name}-{len(stages)}")
        stages.append(stage)
        last = (F.col("n") - 1) < F.shiftleft(F.lit(1).cast("long"), base + span)
        # one node is left if no other stands at its height
        single = last & F.expr("at = 0 and shiftright(n - 1, height) = 0 "
                               "and (height = 0 or shiftright(n - 1, height - 1) > 0)")
        top = stage.filter(single).select("tree", "n", "digest")
        roots = top if roots is None else roots.unionAll(top)
        now = stage.filter(~last & (F.col("height") == base + span)).select("tree", "n", "at", "digest")
        if now.isEmpty():
            return Manifest(stages, roots, span)


class _Segment:
    """The nodes of one subtree in log order, addressed by position."""

    def __init__(self, base: int, span: int):
        self.base, self.span = base, span
        self.own, self.n, self.begin, self.nodes = None, 0, 0, []
        self.way, self.root = b"", None

    def open(self, own) -> None:
        self.own, self.nodes, self.way, self.root = own, [], b"", None

    def add(self, n: int, digest: bytes) -> None:
        if not self.nodes:
            self.n = n
        self.nodes.append(digest)

    def place(self, height: int, at: int) -> int:
        """Where a node stands in the segment: its position in the log of the stage's own levels."""
        count = -(-self.n >> self.base)
        first = self.own[1] << self.span
        return position(height, at, count) - position(0, first, count)

    def path(self, at: int) -> bytes:
        """Steps from node `at` of the segment's lowest level to the root."""
        steps, count = [], -(-self.n >> self.base)
        for height in range(min(self.span, tree_height(count))):
            other = (at >> height) ^ 1
            if other << height >= count:
                steps.append(NONE + bytes(STEP - 1))
            else:
                steps.append((LEFT if at >> height & 1 else RIGHT) + self.nodes[self.place(height, other)])
        return b"".join(steps) + self.way


def _read(base: int, span: int, payload: list[str]):
    def read(batches):
        segment = _Segment(base, span)
        for batch in batches:
            own = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist()))
            kinds, ats = batch.column("kind").to_pylist(), batch.column("at").to_pylist()
            ns, digests = batch.column("n").to_pylist(), batch.column("digest").to_pylist()
            ways = batch.column("way").to_pylist()
            rows, paths, roots = [], [], []
            for k, kind in enumerate(kinds):
                if own[k] != segment.own:
                    segment.open(own[k])
                if kind == WAY:
                    segment.way, segment.root = ways[k], digests[k]
                elif kind == NODE:
                    segment.add(ns[k], digests[k])
                else:
                    rows.append(k)
                    paths.append(segment.path(ats[k]))
                    roots.append(segment.root)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(taken) for c in ("tree", "at", *payload)],
                 pa.array(paths, pa.binary()), pa.array(roots, pa.binary())],
                names=["tree", "at", *payload, "path", "subroot"])

    return read


def paths(space: Workspace, manifest: Manifest, rows: DataFrame, tops: DataFrame, name: str = "ways") -> DataFrame:
    """tree, at, all other columns of rows, path (STEP bytes for each level to the root) and subroot.

    rows: tree, at (a leaf's place) and more. tops: tree, way (steps that follow above the tree's root),
    digest (the tree's root). From the highest stage down, each segment of the log is read by one task
    that holds its 2 ** (SPAN + 1) nodes at most and addresses siblings by their closed-form positions;
    the way from a segment's top upwards comes with it. Only rows of one segment are sorted together.
    """
    payload = [c for c in rows.columns if c not in ("tree", "at")]
    span, last = manifest.span, len(manifest.stages) - 1
    none = lambda kind: F.lit(None).cast(kind)
    sizes = manifest.roots.select(F.col("tree").alias("_tree"), F.col("n").alias("_n"))
    tops = tops.join(sizes, F.col("tree").eqNullSafe(F.col("_tree"))).select("tree", "way", "digest", "_n")
    ways = None
    for k in range(last, -1, -1):
        base = k * span
        # trees whose root is made in this stage
        begins = tops.filter((F.col("_n") - 1 < F.shiftleft(F.lit(1).cast("long"), base + span)) & (
            F.lit(k == 0) | (F.col("_n") - 1 >= F.shiftleft(F.lit(1).cast("long"), base))))
        above = begins.select("tree", F.lit(0).cast("long").alias("block"), "way", "digest")
        if ways is not None:
            above = above.unionAll(ways)
        kept = [rows.schema[c] for c in payload] if k == 0 else []
        extra = [f.name for f in kept]
        held = lambda: [none(f.dataType).alias(f.name) for f in kept]
        asked = rows if k == 0 else manifest.stages[k].filter(F.col("height") == base).select("tree", "at")
        segments = above.select(
            "tree", "block", F.lit(WAY).alias("kind"), none("long").alias("pos"), none("long").alias("at"),
            none("long").alias("n"), "digest", "way", *held()).unionAll(
            manifest.stages[k].select(
                "tree", "block", F.lit(NODE).alias("kind"), "pos", "at", "n", "digest",
                none("binary").alias("way"), *held())).unionAll(
            asked.select(
                "tree", F.shiftright("at", span).alias("block"), F.lit(ROW).alias("kind"), F.col("at").alias("pos"),
                "at", none("long").alias("n"), none("binary").alias("digest"), none("binary").alias("way"), *extra))
        found = segments.repartition("tree", "block").sortWithinPartitions(
            "tree", "block", "kind", "pos", "at").mapInArrow(
            _read(base, span, extra), _schema(kept))
        if k == 0:
            return found
        ways = space.keep(found.select(
            "tree", F.col("at").alias("block"), F.col("path").alias("way"), F.col("subroot").alias("digest")),
            f"{name}-{k}")


def _schema(fields):
    return T.StructType([
        T.StructField("tree", T.StringType()), T.StructField("at", T.LongType()), *fields,
        T.StructField("path", T.BinaryType()), T.StructField("subroot", T.BinaryType())])


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and the steps of its path give."""
    for k in range(0, len(path), STEP):
        side, other = path[k:k + 1], path[k + 1:k + STEP]
        leaf = parent(leaf) if side == NONE else parent(other, leaf) if side == LEFT else parent(leaf, other)
    return leaf


def siblings(path: bytes) -> list[bytes]:
    """The digests of a path, from the leaf upwards."""
    return [path[k + 1:k + STEP] for k in range(0, len(path), STEP) if path[k:k + 1] != NONE]


def _checked(root: bytes, key: str):
    def checked(batches):
        for batch in batches:
            leaves, claimed = batch.column("leaf").to_pylist(), batch.column("claimed").to_pylist()
            steps = batch.column("path").to_pylist()
            proofs = [sha256("".join(d.hex() for d in siblings(p)).encode()).hexdigest() for p in steps]
            tops = [folded(c if c is not None else leaf, p) for leaf, c, p in zip(leaves, claimed, steps)]
            yield pa.RecordBatch.from_arrays([
                batch.column(key), pa.array([d.hex() for d in leaves], pa.string()),
                pa.array([d.hex() for d in batch.column("subroot").to_pylist()], pa.string()),
                pa.array([root.hex()] * len(leaves), pa.string()), pa.array(proofs, pa.string()),
                pa.array([d.hex() for d in tops], pa.string()), pa.array([d == root for d in tops], pa.bool_())],
                names=[key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return checked


def audited(docs: DataFrame, claimed: Column | None = None, space: Workspace | None = None,
            span: int | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    docs: doc_id, source, lang, n_chars, text; other columns are ignored. A leaf is the digest of these
    five (`encoded`). Each lang is a tree of its documents by doc_id; the trees' roots, by lang, make
    the tree of the whole. proof_sha256 is the digest of a leaf's sibling digests from the leaf to the
    root; folded_root is what they make of `claimed`, a digest (hex) of what a row is now said to be,
    or of the leaf where that is null; verified says whether it is the root.

    Nulls: a null lang is a tree of its own and the first; null ids come first in their tree; fields
    that are null are hashed as `-`. Ties: rows with equal doc_id stand in order of their leaves, so
    repeated rows are leaves side by side. Empty and very long texts are hashed whole. An empty
    table gives no rows.

    Texts are read once; digests are sorted by ranges of (lang, doc_id), so a lang may hold any share
    of the rows. Only the root comes to the driver.
    """
    space = space or Workspace(docs.sparkSession, "merkle")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    none = F.lit(None).cast("binary")
    leaves = space.keep(docs.select(
        F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(digest_of(fields)).alias("leaf"),
        (none if claimed is None else F.unhex(claimed)).alias("claimed")), "leaves")
    rows = numbered(space, leaves, "tree", ["doc_id", "leaf"], "ordered").withColumnRenamed("rank", "at")
    trees = build(space, rows.select("tree", "n", "at", F.col("leaf").alias("digest")), "log", span)
    lots = numbered(space, trees.roots.withColumnRenamed("tree", "lang"), None, ["lang"], "langs", count="langs")
    lots = lots.select("lang", F.lit("").alias("tree"), F.col("langs").alias("n"), F.col("rank").alias("at"), "digest")
    whole = build(space, lots, "top", span)
    root = whole.roots.first()
    if root is None:
        return docs.sparkSession.createDataFrame([], _AUDIT)
    ends = whole.roots.select("tree", F.lit(b"").alias("way"), "digest")
    above = paths(space, whole, lots.select("tree", "at", "lang", F.col("digest").alias("own")), ends, "top-ways")
    tops = space.keep(above.select(
        F.col("lang").alias("tree"), F.col("path").alias("way"), F.col("own").alias("digest")), "tops")
    proofs = paths(space, trees, rows.select("tree", "at", "doc_id", "leaf", "claimed"), tops)
    return proofs.mapInArrow(_checked(bytes(root["digest"]), "doc_id"), _AUDIT)


_AUDIT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")
