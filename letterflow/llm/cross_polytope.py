"""Near duplicates of vectors: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets, verification."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterflow.llm.components import components
from letterflow.llm.tables import Workspace
from letterflow.llm.textcols import U64, mix, stream

#: Vectors are linked from this cosine on.
LEAST = 0.9
#: Of each hash a vector takes so many strongest coordinates; of their combinations the best PROBES.
ALTERNATES, PROBES = 3, 9
#: Vectors that meet in a bucket by chance, about: the hashes of a table follow from it and the vectors' number.
LOAD = 256
#: Share of pairs at exactly the least cosine that may share no bucket; the number of tables follows from it.
MISS = 1e-4
#: Rounds of signs and Hadamard transform in a rotation.
ROUNDS = 3
#: Pairs simulated to learn how often a table finds one.
TRIALS = 2048
#: Vectors of a block: a larger bucket is compared block by block, each pair of blocks in a cell of its own.
BLOCK = 2048
#: Rows of a cell multiplied at once.
STRIPE = 256
#: Larger buckets told to all tasks at once are at most so many; more are joined.
TOLD = 1 << 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; a row's length is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        pairs = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x / math.sqrt(d)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random rotation, the same in every task: random signs and a Hadamard transform, ROUNDS times."""
    d = x.shape[1]
    bits = np.unpackbits(stream(seed, ROUNDS * -(-d // 64)).view(np.uint8)).reshape(ROUNDS, -1)[:, :d]
    for signs in bits.astype(np.float64) * 2 - 1:
        x = hadamard(x * signs)
    return x


@dataclass(frozen=True)
class Tables:
    """Hash tables for vectors of a padded length: `hashes` cross-polytopes each, the last over `last` coordinates."""

    width: int
    hashes: int
    last: int
    tables: int

    def dims(self) -> list[int]:
        return [self.width] * (self.hashes - 1) + [self.last]

    def codes(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Buckets of each row in a table, rows x probes: those of the largest sums of coordinates.

        The hash of a vector is the axis nearest to it once rotated, with its sign; the next ones are
        where a near vector may fall instead.
        """
        picks, values = [], []
        for h, dim in enumerate(self.dims()):
            seen = rotated(unit, 1 + table * 64 + h)[:, :dim]
            take = min(ALTERNATES, dim)
            order = np.argsort(-np.abs(seen), axis=1, kind="stable")[:, :take]
            top = np.take_along_axis(seen, order, 1)
            picks.append((order * 2 + (top > 0)).astype(U64))
            values.append(np.abs(top))
        ways = np.array(list(product(*[range(v.shape[1]) for v in values])))
        strength = sum(v[:, ways[:, h]] for h, v in enumerate(values))
        best = np.argsort(-strength, axis=1, kind="stable")[:, :PROBES]
        key = np.full(best.shape, U64(self.width * 4096 + table), U64)
        for h, pick in enumerate(picks):
            key = mix(key * U64(0x9E3779B97F4A7C15) + np.take_along_axis(pick, ways[best, h], 1) + U64(1))
        return key

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Sorted buckets of each row over all tables."""
        return np.sort(np.concatenate([self.codes(unit, t) for t in range(self.tables)], axis=1), axis=1)


def found_share(tables: Tables, least: float, trials: int = TRIALS) -> float:
    """How often a pair of random vectors at the least cosine shares a bucket of one table, by simulation."""
    rng = np.random.default_rng(29)
    a, b = rng.normal(size=(2, trials, tables.width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = least * a + math.sqrt(max(0.0, 1 - least * least)) * b
    x, y = tables.codes(a, 0), tables.codes(b, 0)
    return float((x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean())


def plan(vectors: int, length: int, least: float = LEAST) -> Tables:
    """Tables for so many vectors of a length: buckets enough for LOAD by chance, tables enough for MISS.

    The rule has no steps where pairs get lost: more vectors make finer buckets, and finer buckets more
    tables, so that a pair at the least cosine is missed no more often.
    """
    width = 1 << max(1, (length - 1).bit_length())
    bits = max(1.0, math.log2(max(2.0, vectors * PROBES / LOAD)))
    per_hash = math.log2(2 * width)
    hashes = max(1, math.ceil(bits / per_hash))
    last = 1 << max(0, math.ceil(bits - per_hash * (hashes - 1)) - 1)
    one = Tables(width, hashes, min(width, last), 1)
    share = min(found_share(one, least), 0.999)
    return Tables(width, hashes, one.last, math.ceil(math.log(MISS) / math.log1p(-max(share, 1e-3))))


def _lists(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a list column, where each row begins, and which rows are whole: not null and without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = column.flatten()
    holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    whole = (holes[at[1:]] == holes[at[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    return flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), at, whole


def _read(kind: str):
    def read(batches):
        """Content of each vector that can be linked, and its digest; null for others."""
        for batch in batches:
            values, at, whole = _lists(batch.column("embedding"))
            contents, digests = [], []
            for a, b, ok in zip(at[:-1], at[1:], whole):
                own = values[a:b] + 0.0  # minus zero is zero
                if ok and b > a and np.isfinite(own).all() and own.any():
                    contents.append(own.astype(kind).tobytes())
                    digests.append(hashlib.blake2b(contents[-1], digest_size=16).digest())
                else:
                    contents.append(None)
                    digests.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("rid"), pa.array(digests, pa.binary()),
                 pa.array(contents, pa.binary())], names=["vec_id", "rid", "digest", "content"])

    return read


def _units(contents: list[bytes], kind: str) -> np.ndarray:
    """Contents of one length as vectors of length 1, in double precision."""
    x = np.frombuffer(b"".join(contents), kind).reshape(len(contents), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def padded(unit: np.ndarray, width: int) -> np.ndarray:
    return np.pad(unit, ((0, 0), (0, width - unit.shape[1])))


def _hashed(plans: dict[int, Tables], kind: str):
    def hashed(batches):
        for batch in batches:
            contents = batch.column("content").to_pylist()
            keys: list[np.ndarray] = [np.zeros(0, np.int64)] * len(contents)
            for size in {len(c) for c in contents}:
                own = [k for k, c in enumerate(contents) if len(c) == size]
                tables = plans[size]
                unit = _units([contents[k] for k in own], kind)
                for k, row in zip(own, tables.buckets(padded(unit, tables.width)).view(np.int64)):
                    keys[k] = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names, "buckets"])

    return hashed


class _Cell:
    """Vectors of a bucket, or of two of its blocks, compared with each other."""

    def __init__(self, bucket: int, apart: bool, plans: dict[int, Tables], kind: str, least: float):
        self.bucket, self.apart = U64(bucket & (1 << 64) - 1), apart
        self.plans, self.kind, self.least = plans, kind, least
        self.rows: list[tuple[int, int, int, bytes]] = []

    def _first_meeting(self, a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which pairs share no smaller bucket than this one: each pair counts in one cell only."""
        left = np.arange(len(a))
        for s in range(keys.shape[1]):
            if not len(left):
                break
            mine = keys[a[left], s]
            smaller = mine < self.bucket
            if not smaller.any():
                break  # buckets are sorted
            met = smaller & (keys[b[left]] == mine[:, None]).any(axis=1)
            left = left[~met]
        out = np.zeros(len(a), bool)
        out[left] = True
        return out

    def compared(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Links that join what is linked here, and for each vector the weight of those it is linked with."""
        sides = {side for _, _, side, _ in self.rows}
        if len(self.rows) < 2 or self.apart and len(sides) < 2:
            return [], []
        links, weights = [], {}
        sizes: dict[int, list] = {}
        for row in self.rows:
            sizes.setdefault(len(row[3]), []).append(row)
        for size, rows in sizes.items():
            tables = self.plans[size]
            ids = np.array([r[0] for r in rows], np.int64)
            weight = np.array([r[1] for r in rows], np.int64)
            side = np.array([r[2] for r in rows])
            unit = _units([r[3] for r in rows], self.kind)
            label, total = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            keys, known = None, np.zeros(len(rows), bool)
            for low in range(0, len(rows), STRIPE):
                near = unit[low:low + STRIPE] @ unit[low:].T >= self.least
                a, b = np.nonzero(near)
                a, b = a + low, b + low
                ahead = (b > a) & (side[a] != side[b]) if self.apart else b > a
                a, b = a[ahead], b[ahead]
                if not len(a):
                    continue
                # buckets are hashed again for the few vectors that are near others, rather than shuffled with all
                new = np.unique(np.concatenate([a, b]))
                new = new[~known[new]]
                if len(new):
                    made = tables.buckets(padded(unit[new], tables.width))
                    keys = np.zeros((len(rows), made.shape[1]), U64) if keys is None else keys
                    keys[new], known[new] = made, True
                mine = self._first_meeting(a, b, keys)
                a, b = a[mine], b[mine]
                np.add.at(total, a, weight[b])
                np.add.at(total, b, weight[a])
                for x, others in zip(*_by_first(a, b)):
                    apart = others[label[others] != label[x]]
                    if len(apart):
                        kinds, at = np.unique(label[apart], return_index=True)
                        links += [(int(ids[x]), int(ids[apart[k]])) for k in at]
                        label[np.isin(label, kinds)] = label[x]
            weights.update((int(i), int(t)) for i, t in zip(ids[total > 0], total[total > 0]))
        return links, list(weights.items())


def _by_first(a: np.ndarray, b: np.ndarray):
    """Each distinct a (they come sorted) and the b beside it."""
    first, at = np.unique(a, return_index=True)
    return first, np.split(b, at[1:])


def _compared(plans: dict[int, Tables], kind: str, least: float):
    def compared(batches):
        """Rows come sorted by cell; one cell is held at a time."""
        own, cell = None, None

        def done(cells):
            a, b, n = [], [], []
            for c in cells:
                links, weights = c.compared()
                a += [x for x, _ in links] + [x for x, _ in weights]
                b += [y for _, y in links] + [None] * len(weights)
                n += [0] * len(links) + [w for _, w in weights]
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            closed = []
            places = zip(*(batch.column(c).to_pylist() for c in ("bucket", "one", "two")))
            rest = zip(*(batch.column(c).to_pylist() for c in ("id", "weight", "side", "content")))
            for place, row in zip(places, rest):
                if place != own:
                    if cell is not None:
                        closed.append(cell)
                    own, cell = place, _Cell(place[0], place[1] != place[2], plans, kind, least)
                cell.rows.append(row)
            yield done(closed)
        yield done([cell] if cell is not None else [])

    return compared


def _cells(banded: DataFrame, large: DataFrame, told: bool) -> DataFrame:
    """Rows of the buckets by cell: (bucket, one, two) are the two blocks compared there, side tells which is a row's."""
    sizes = large.select(F.col("bucket").alias("_bucket"), "blocks")
    spread = banded.join(F.broadcast(sizes) if told else sizes, F.col("bucket") == F.col("_bucket"), "left").withColumn(
        "blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn(
        "own", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")))
    return spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "bucket", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "weight", "content")


def near_vectors(vectors: DataFrame, least: float = LEAST, space: Workspace | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector, by vec_id and embedding; other columns are ignored.

    Vectors are linked if their cosine, in double precision, is `least` or more. n_links counts the
    other vectors linked directly, component_id is the smallest vec_id reachable over links.

    * Equal vectors are one class, with the number of its rows as weight; only classes are compared.
    * A class goes to the buckets of its PROBES best cross-polytopes in each table. How many hashes
      make a table and how many tables there are, `plan` says: a pair at exactly `least` shares no
      bucket with a probability of about MISS, nearer ones hardly ever.
    * In each bucket all vectors are compared by their dot products; a pair counts in the smallest
      bucket that both have. A bucket of more than BLOCK is compared in pairs of blocks, each in a
      cell of its own, so no task holds a bucket. A cell gives at most one link and one sum a vector:
      pairs are never written out.

    Vectors that are null, empty or zero, or hold null or non-finite numbers, are linked with nothing:
    n_links 0, component_id their own vec_id. Vectors of unlike length are not linked. Rows without vec_id
    are compared like others, but name no component: component_id is null if none there has one, and such rows are kept
    only then. Repeated rows are linked with each other. An empty table gives no rows.
    """
    space = space or Workspace(vectors.sparkSession, "near-vectors")
    array = dict(vectors.dtypes)["embedding"]
    kind = "<f4" if array == "array<float>" else "<f8"
    rows = space.keep(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("rid"),
        F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding")).mapInArrow(
        _read(kind), "vec_id long, rid long, digest binary, content binary"), "rows")
    classes = space.keep(rows.filter("digest is not null").groupBy("digest").agg(
        F.min("rid").alias("id"), F.min("vec_id").alias("name"), F.count("*").alias("weight"),
        F.first("content").alias("content")), "classes")
    lengths = classes.groupBy(F.octet_length("content").alias("size")).agg(F.count("*").alias("n")).collect()
    plans = {r["size"]: plan(r["n"], r["size"] // np.dtype(kind).itemsize, least) for r in lengths}
    hashed = space.keep(classes.select("id", "weight", "content").mapInArrow(
        _hashed(plans, kind), "id long, weight long, content binary, buckets array<long>"), "hashed")
    large = space.keep(hashed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("n")).filter(F.col("n") > BLOCK).select(
        "bucket", F.ceil(F.col("n") / BLOCK).alias("blocks")), "large")
    told = large.count() <= TOLD
    cells = _cells(hashed.withColumn("bucket", F.explode(F.array_distinct("buckets"))), large, told)
    found = space.keep(cells.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two").mapInArrow(
        _compared(plans, kind, least), "a long, b long, n long"), "found")
    roots = components(space, found.filter("b is not null").select("a", "b"), "components")
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    placed = space.keep(classes.select("digest", "id", "name", "weight").join(
        counts, F.col("id") == F.col("node"), "left").drop("node").join(
        roots, F.col("id") == F.col("node"), "left").select(
        "digest", "name", F.coalesce("root", "id").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "placed")
    names = placed.groupBy("root").agg(F.min("name").alias("least"))
    known = placed.select("digest", "n_links", "root").join(names, "root").select(
        F.col("digest").alias("_digest"), "n_links", "least")
    return rows.select("vec_id", "digest").join(known, F.col("digest") == F.col("_digest"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
