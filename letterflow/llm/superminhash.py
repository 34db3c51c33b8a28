"""Near duplicates by SuperMinHash signatures, banding, verification on whole sets and union-find."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterflow.llm.cells import buckets, grouped
from letterflow.llm.tables import Workspace, unused
from letterflow.llm.textcols import U64, blocks, distinct, mix, rows_of, shingles, utf8, words

SLOTS = 128
#: Slots in a band.
ROWS = 4
#: Texts are linked if 100 * shared >= PERCENT * united.
PERCENT = 75


def signatures(elements: np.ndarray, begin: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each row's elements, rows x slots; a row without elements keeps the maximum.

    In round j every element draws the j-th entry of its own random permutation of the slots (one
    Fisher-Yates swap) and offers that slot the rank j plus a random fraction. A row is done as
    soon as all of its slots hold ranks of at most j, since later rounds only offer more: for rows
    of several hundred elements that is after two or three rounds.
    """
    n = len(begin) - 1
    best = np.full(n * slots, np.iinfo(np.uint64).max, U64)
    row = rows_of(begin)
    x, permutation = elements, None
    for j in range(slots):
        if not len(x):
            break
        drawn = mix(x + U64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = (j + (((drawn >> U64(32)) * U64(slots - j)) >> U64(32))).astype(np.int64)
        if permutation is None:
            permutation = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(x), slots)).copy()
        each = np.arange(len(x))
        slot = permutation[each, k]
        permutation[each, k] = permutation[:, j]
        np.minimum.at(best, row * slots + slot, (drawn & U64(0xFFFFFFFF)) | U64(j << 32))
        done = best.reshape(n, slots).max(axis=1) < U64((j + 1) << 32)
        left = ~done[row]
        x, row, permutation = x[left], row[left], permutation[left]
    return best.reshape(n, slots)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of `rows` slots."""
    n, slots = signature.shape
    bands = slots // rows
    parts = signature[:, :bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), (n, bands)).copy()
    for r in range(rows):
        key = mix(key ^ parts[:, :, r]) + U64(r + 1)
    return key.view(np.int64)


def _signed(batches):
    """Set size, set digest and band keys of each text."""
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        sizes, digests, keys = [], [], []
        for first, last in blocks(at):
            hashed, _, _, begin = words(raw[at[first]:at[last]], at[first:last + 1] - at[first])
            elements, begin = distinct(*shingles(hashed, begin))
            size = np.diff(begin)
            sizes.append(size)
            digests += [
                hashlib.blake2b(elements[a:b].tobytes(), digest_size=16).hexdigest() if b > a else None
                for a, b in zip(begin[:-1], begin[1:])]
            keys.append(band_keys(signatures(elements, begin)))
        n = len(batch)
        bands = np.concatenate(keys) if keys else np.zeros((0, SLOTS // ROWS), np.int64)
        yield pa.RecordBatch.from_arrays([
            *[batch.column(c) for c in ("doc_id", "rid", "key")],
            pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)),
            pa.array(digests, pa.string()),
            pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1) * bands.shape[1], pa.int32()), pa.array(bands.ravel()))],
            names=["doc_id", "rid", "key", "n_shingles", "digest", "bands"])


def _sets(batches):
    """The whole set of each text, as the bytes of its sorted distinct shingle hashes."""
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        packed = []
        for first, last in blocks(at):
            hashed, _, _, begin = words(raw[at[first]:at[last]], at[first:last + 1] - at[first])
            elements, begin = distinct(*shingles(hashed, begin))
            packed += [elements[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(packed, pa.binary())], names=["key", "content"])


class Sets:
    """Sets held in a cell: which of them are linked with another set."""

    def __init__(self, contents: list[bytes]):
        sets = [np.frombuffer(c, U64) for c in contents]
        self.sizes = np.array([len(x) for x in sets])
        every, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.every, self.who = every[order], who[order]

    def near(self, content: bytes) -> np.ndarray:
        x = np.frombuffer(content, U64)
        low, high = np.searchsorted(self.every, x, "left"), np.searchsorted(self.every, x, "right")
        count = high - low
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shared = np.bincount(self.who[at], minlength=len(self.sizes))
        return 100 * shared >= PERCENT * (self.sizes + len(x) - shared)


def _row_key() -> Column:
    """doc_id and digest of the text: rows with equal ones are the same document."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.sha2(
        F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def _grouped(docs: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, digest) of every row, and of each class of equal sets: digest, component_id and keeper.

    A row's place in the signed table tells it from all others, whatever its doc_id; doc_ids only name
    components. keeper is the key of the row that stays for a component.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
                        _row_key().alias("key"), F.col("text").cast("string").alias("text"))
    signed = space.keep(texts.mapInArrow(
        _signed, "doc_id long, rid long, key string, n_shingles long, digest string, bands array<long>"), "signed")
    # rows of a class have equal sets, so equal bands; a row with a doc_id stands for it if there is one
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key"))
    classes = space.keep(signed.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("rid").alias("id"), first.alias("first"), F.first("bands").alias("bands")), "classes")
    shared = space.keep(buckets(classes.select(F.explode("bands").alias("bucket"), "id")), "shared")
    classes = classes.drop("bands")
    wanted = classes.join(shared.select("id").distinct(), "id", "left_semi").select(F.col("first.key").alias("key"), "id")
    sets = space.keep(
        texts.join(wanted.select("key"), "key", "left_semi")
        .mapInArrow(_sets, "key string, content binary").groupBy("key").agg(F.first("content").alias("content"))
        .join(wanted, "key").select("id", "content"), "sets")
    roots = grouped(space, shared, sets, Sets)
    placed = space.keep(classes.join(roots, F.col("id") == F.col("node"), "left").select(
        "digest", "first", F.coalesce("root", "id").alias("root")), "placed")
    for done in ("classes", "shared", "sets", "last"):
        space.remove(done)
    names = placed.groupBy("root").agg(F.min("first").alias("least"))
    return signed.select("doc_id", "n_shingles", "digest"), placed.join(names, "root").select(
        F.col("digest").alias("_digest"), F.col("least.doc_id").alias("name"), F.col("least.key").alias("keeper"))


def near_duplicates(docs: DataFrame, space: Workspace | None = None) -> DataFrame:
    """Near-duplicate group of every document, by doc_id and text; other columns are ignored.

    Texts are linked if 100 * shared >= 75 * united of their distinct five-word shingles. Returns
    doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    * Equal sets form a class; only classes are compared.
    * Classes that share a band of their signatures are candidates, and verified on whole sets as
      `cells.grouped` says.
    * A link at exactly 0.75 shares none of the 32 bands with probability 5e-6; at 0.8, 5e-8.

    Null, empty or white-space texts have the empty set and are linked with nothing. Rows are told apart
    by their place, so several texts may have one doc_id, and each is linked by itself. Rows without
    doc_id are linked like others but name no component: component_id is null if no row there has a doc_id, and such
    rows are kept only then. Repeated rows give repeated rows. An empty table gives no rows.
    """
    space = space or Workspace(docs.sparkSession, "near-duplicates")
    signed, classes = _grouped(docs, space)
    return signed.join(classes, F.col("digest") == F.col("_digest"), "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("_digest").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, space: Workspace | None = None) -> DataFrame:
    """The documents without near duplicates: of each group one, that with the smallest doc_id, with all its columns.

    Of rows with the same doc_id and different texts all are documents of their own; of a group's rows
    with the smallest doc_id the one with the least digest stays, of rows equal in doc_id and text any
    one. Groups in which no row has a doc_id keep one row, too. Texts without words are no duplicates and all stay. An
    empty table gives no rows.
    """
    space = space or Workspace(docs.sparkSession, "keep-one")
    _, classes = _grouped(docs, space)
    key, keeper = unused(docs, "key", "keeper")
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = classes.select(F.col("keeper").alias(keeper)).distinct()
    once = docs.filter(worded).withColumn(key, _row_key()).join(
        kept, F.col(key) == F.col(keeper)).drop(keeper).dropDuplicates([key]).drop(key)
    return once.unionAll(docs.filter(~worded))
