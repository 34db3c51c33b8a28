"""Fingerprints by randomised edit embedding: shared random walks, sampled bits, banding and verification."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterflow.llm.cells import buckets, grouped
from letterflow.llm.tables import Workspace
from letterflow.llm.textcols import U64, mix, stream

#: Bits of a fingerprint; those from the upper half of the steps, from the quarter below, and so on.
BITS = 256
SHARES = (128, 64, 32, 16, 8, 4, 2)
#: Further bits of a fingerprint, which hold the walk's steps until its text ends.
REACH_BITS = 48
#: Steps after which the walk's random choices repeat, and kinds of characters they know.
PERIOD, KINDS = 4096, 256
#: The symbol of a step after the end of the text.
END = KINDS
#: Characters walked over at once, and steps of a text between two looks at the samples.
BLOCK_CHARS, CHUNK = 1 << 23, 512
#: Bands of bits and bits in each that lie before the texts' ends, drawn at random once and for all.
BANDS, BAND_BITS = 40, 14
#: Documents of a part, of which one travels twice, while there are no more parts than the driver
#: keeps bounds of; beyond that parts are longer, which tasks don't mind as documents pass one by one.
PART_DOCS, PARTS = 1024, 1 << 16
#: First bytes of a text that cut the rows of a common doc_id, and keys of such rows sampled for each range.
PREFIX, SAMPLES = 32, 8

_tables: dict[str, np.ndarray] = {}


def _walk() -> np.ndarray:
    """KINDS times the steps that a walk at step j (modulo PERIOD) spends on a character of a kind.

    One and more by chance; at the last step of a period every character is left.
    """
    if "walk" not in _tables:
        moves = np.unpackbits(stream(41, PERIOD * KINDS // 64).view(np.uint8)).reshape(PERIOD, KINDS).astype(bool)
        moves[-1] = True
        steps = np.zeros((PERIOD, KINDS), np.uint16)
        wait = np.zeros(KINDS, np.uint16)
        for j in range(PERIOD - 1, -1, -1):
            wait = np.where(moves[j], 1, wait + 1)
            steps[j] = wait
        _tables["walk"] = steps.ravel().astype(np.int32) * KINDS
    return _tables["walk"]


def _samples(scale: int):
    """Sampled steps of texts of up to 2 ** scale characters, ascending, and which slot each fills.

    The upper half of the 2 ** (scale + 1) steps such a walk takes on average fills 128 slots, the quarter
    below 64, and so on. Slot t of an octave samples the same step at every scale that has it.
    """
    key = f"samples{scale}"
    if key not in _tables:
        steps, names = [], []
        for depth, share in enumerate((*SHARES, BITS - sum(SHARES))):
            octave = scale - depth
            low, width = ((1 << octave), 1 << octave) if octave >= 0 and depth < len(SHARES) else (
                0, max(1, 1 << max(octave + 1, 0)))
            slot = np.arange(share)
            drawn = mix(slot.astype(U64) + mix(np.array([low], U64)))
            steps.append(low + (drawn % U64(width)).astype(np.int64))
            names.append(low * BITS + slot)
        steps, names = np.concatenate(steps), np.concatenate(names)
        order = np.argsort(steps, kind="stable")
        _tables[key] = np.stack([steps[order], order, names[order]])
    return _tables[key]


def scale_of(n: int) -> int:
    """Least k for which 2 ** k is n or more."""
    return max(n - 1, 0).bit_length()


def _kinds(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    far = code >= KINDS
    if far.any():
        code = np.where(far, (code * np.uint32(2654435761)) >> np.uint32(24), code)
    return code.astype(np.uint8)


def sampled_symbols(texts: list[np.ndarray]) -> np.ndarray:
    """What stands at the sampled steps of each text's embedding, texts x BITS, by slot."""
    return _walked(texts)[0]


def _walked(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sampled symbols of each text, and the steps its whole walk takes.

    All texts walk side by side: at a step the walk writes the character it stands on, and the shared
    random choice for that step and character says whether it moves on.
    """
    n = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-n, kind="stable")
    symbols = np.concatenate([*texts, np.zeros(CHUNK, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(symbols, CHUNK)
    begin = np.concatenate([[0], np.cumsum(n)])[:-1][order]
    size = n[order]
    out = np.full((len(texts), BITS), END, np.int64)
    scale = np.array([scale_of(int(k)) for k in size])
    walk = _walk()
    step = np.zeros(len(texts), np.int64)
    for first in range(0, int(size[0]) if len(size) else 0, CHUNK):
        going = int(np.searchsorted(-size, -first, "left"))  # texts longer than `first`
        last = min(CHUNK, int(size[0]) - first)
        seen = np.ascontiguousarray(windows[begin[:going] + first].T)
        live = np.searchsorted(-size, -(first + np.arange(last)), "left").tolist()
        # steps since the chunk began, after a whole number of periods, times KINDS
        ahead = (step[:going] % PERIOD).astype(np.int32) * KINDS
        at = np.empty((last + 1, going), np.int32)
        at[0] = ahead
        spot = np.empty(going, np.int32)
        moved = np.empty(going, np.int32)
        for w in range(last):
            k = live[w]
            now, place, move = ahead[:k], spot[:k], moved[:k]
            np.bitwise_and(now, PERIOD * KINDS - 1, out=place)
            np.bitwise_or(place, seen[w, :k], out=place)
            np.take(walk, place, out=move, mode="clip")
            np.add(now, move, out=now)
            at[w + 1] = ahead
        passed = at.T // KINDS + (step[:going] // PERIOD * PERIOD)[:, None]
        reach = int(passed[:, -1].max()) + 1
        row_key = (passed + (np.arange(going) * reach)[:, None]).ravel()
        for s in np.unique(scale[:going]):
            steps, slot, _ = _samples(int(s))
            own = np.flatnonzero(scale[:going] == s)
            low = np.searchsorted(steps, passed[own, 0], "left")
            count = np.searchsorted(steps, passed[own, -1], "left") - low
            who = np.repeat(own, count)
            pick = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            w = np.searchsorted(row_key, who * reach + steps[pick], "right") - 1 - who * (last + 1)
            out[order[who], slot[pick]] = seen[w, who]
        step[:going] = passed[:, -1]
    reach = np.empty(len(texts), np.int64)
    reach[order] = step
    return out, reach


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scale of each text and its bits.

    One for each sampled step, a random function of what stands there; then REACH_BITS with the steps of
    the walk, which tell the samples behind the text's end.
    """
    kinds = [_kinds(t) for t in texts]
    scales = np.array([scale_of(len(k)) for k in kinds], np.int64)
    symbols, reach = _walked(kinds)
    bits = np.zeros((len(texts), BITS + REACH_BITS), np.uint8)
    bits[:, BITS:] = np.unpackbits(reach.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, -REACH_BITS:]
    for s in np.unique(scales):
        own = scales == s
        bits[own, :BITS] = _coins(int(s), symbols[own])
    return scales, bits


def _coins(scale: int, symbols: np.ndarray) -> np.ndarray:
    """The bit of each slot of a scale for what stands there."""
    names = np.empty(BITS, np.int64)
    _, slot, name = _samples(scale)
    names[slot] = name
    coin = mix(names.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(9))
    return (mix(coin + symbols.astype(U64) * U64(0xD1342543DE82EF95)) >> U64(17)).astype(np.uint8) & 1


def _steps(scale: int) -> np.ndarray:
    """Sampled step of each slot of a scale."""
    steps, slot, _ = _samples(scale)
    out = np.empty(BITS, np.int64)
    out[slot] = steps
    return out


def _reach(bits: np.ndarray) -> np.ndarray:
    return bits[:, BITS:].astype(np.int64) @ (np.int64(1) << np.arange(REACH_BITS - 1, -1, -1))


def _shared_slots(gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a scale, and of one that is larger by `gap`, which sample the same steps."""
    if gap == 0:
        return np.arange(BITS), np.arange(BITS)
    begin = np.concatenate([[0], np.cumsum(SHARES)])
    low = [begin[d - gap] + np.arange(SHARES[d]) for d in range(gap, len(SHARES))]
    return (np.concatenate([np.zeros(0, np.int64), *low]),
            np.arange(begin[min(gap, len(SHARES))], begin[-1]))


def likeness(scale_a, bits_a, scale_b, bits_b) -> np.ndarray:
    """How alike fingerprints are, 0 to 1, row by row: bits that agree beyond chance.

    Only steps that at least one of the texts reaches count; where just one does, they differ. A text of
    a smaller scale has half of the other's samples within its octaves; above them its walk has
    ended, and the few steps that it still takes there unsampled don't count. Two empty texts are alike.
    """
    out = np.zeros(len(bits_a))
    scale_a, scale_b = np.asarray(scale_a), np.asarray(scale_b)
    reach_a, reach_b = _reach(bits_a), _reach(bits_b)
    for low, high in np.unique(np.sort(np.stack([scale_a, scale_b], axis=1), axis=1), axis=0).tolist():
        slots, others = _shared_slots(high - low)
        steps = _steps(high)
        for turned in (False, True) if low < high else (False,):
            own = np.flatnonzero((scale_a == (high if turned else low)) & (scale_b == (low if turned else high)))
            a, b, ra, rb = bits_a[own], bits_b[own], reach_a[own, None], reach_b[own, None]
            if turned:
                a, b, ra, rb = b, a, rb, ra
            in_a, in_b = steps[others] < ra, steps[others] < rb
            both = in_a & in_b
            agree = (both & (a[:, slots] == b[:, others])).sum(axis=1)
            count = (in_a | in_b).sum(axis=1)
            above = steps[:others[0] if len(others) else sum(SHARES)]
            count += ((above < ra) != (above < rb)).sum(axis=1)
            empty = (ra[:, 0] == 0) & (rb[:, 0] == 0)
            out[own] = np.where(empty, 1, np.clip((2 * agree - both.sum(axis=1)) / np.maximum(count, 1), 0, 1))
    return out


def as_text(scales: np.ndarray, bits: np.ndarray) -> list[str]:
    packed = np.packbits(bits, axis=1)
    return [f"{s:02x}{row.tobytes().hex()}" for s, row in zip(scales.tolist(), packed)]


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first characters of the next."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compared(batches):
    """Fingerprints of each document, of its edited text, and how alike they and the next one's are.

    Rows come by part, in order, with the next part's first row at the end.
    """
    held: list[tuple[int, str, str]] = []
    chars, before = 0, None
    for batch in batches:
        parts, copied = batch.column("part").to_pylist(), batch.column("copied").to_pylist()
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for part, copy, doc, text in zip(parts, copied, ids, texts):
            if before is not None and before[0] == part:
                held.append((before[1], before[2], text))
                chars += 2 * len(before[2])
            before = None if copy else (part, doc, text)
            if chars >= BLOCK_CHARS:
                yield _measured(held)
                held, chars = [], 0
    yield _measured(held)


def _measured(held: list[tuple[int, str, str]]) -> pa.RecordBatch:
    texts, index = [], []
    for k, (_, text, _) in enumerate(held):
        if k == 0 or held[k - 1][2] is not text:
            texts.append(text)
        index.append(len(texts) - 1)
        texts.append(held[k][2])
    after = np.array(index, np.int64) + 1
    changed = [edited(text, following) for _, text, following in held]
    scales, bits = fingerprints(texts + changed)
    own, new = np.array(index, np.int64), len(texts) + np.arange(len(held))
    names = as_text(scales, bits)
    return pa.RecordBatch.from_arrays([
        pa.array([d for d, _, _ in held], pa.int64()),
        pa.array([len(t) for _, t, _ in held], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed], pa.string()),
        pa.array([names[i] for i in own], pa.string()), pa.array([names[i] for i in new], pa.string()),
        pa.array(likeness(scales[own], bits[own], scales[new], bits[new])),
        pa.array(likeness(scales[own], bits[own], scales[after], bits[after]))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _key_of(order: float) -> bytes:
    return ((1 << 63) - 1 - max(-(1 << 63), min(int(order), (1 << 63) - 1))).to_bytes(8, "big")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document beside that of its edited text and of the next document.

    docs: doc_id, text; other columns are ignored. The next document is the one with the next smaller
    doc_id, after the last the first; rows with equal doc_id stand in order of text, those without
    come last. A null text is empty. One row for each row; an empty table gives none.

    Documents are dealt into ranges of that order with about PART_DOCS rows, of which there are at most
    PARTS. A doc_id that fills several ranges, or rows without one, are cut by the first PREFIX bytes
    of their texts; only texts that begin alike under one doc_id stay together. The first document
    of each range goes to the range before it as well, so each text is moved once.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("order"))
    rows = texts.count()
    parts = min(max(1, rows // PART_DOCS), PARTS)
    edges = texts.approxQuantile("order", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    # keys stand in the order of the result: doc_id descending, then the text's first bytes where an id is common
    common = sorted(v for v, n in Counter(edges).items() if n > 1)
    key = F.unhex(F.lpad(F.hex(F.bitwise_not(F.col("order").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0"))
    if common:
        is_common = F.col("order").cast("double").isin(common)
        key = F.concat(key, F.when(is_common, F.substring(F.col("text").cast("binary"), 1, PREFIX)).otherwise(F.lit(b"")))
    cuts = {_key_of(v) + b"\xff" * PREFIX for v in edges}
    if common:
        some = texts.filter(is_common).select(key.alias("key")).sample(min(1.0, SAMPLES * parts / rows), seed=1)
        cuts.update(sorted(r["key"] for r in some.collect())[SAMPLES::SAMPLES])
    bounds = np.array(sorted(cuts), f"S{8 + PREFIX}")

    def place(keys: pd.Series) -> np.ndarray:
        return np.searchsorted(bounds, np.array(keys.to_list(), bounds.dtype), "left").astype(np.int32)

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(place(keys))

    tops = sorted(texts.select(key.alias("key")).select("key", part_of("key").alias("part")).groupBy("part").agg(
        F.min("key").alias("top")).collect(), key=lambda r: r["part"])
    into = {bytes(r["top"]): tops[k - 1]["part"] for k, r in enumerate(tops)}  # the first one's part is the last

    @F.pandas_udf("array<int>")
    def parts_of(keys: pd.Series) -> pd.Series:
        return pd.Series([[int(p), into[k]] if k in into else [int(p)] for p, k in zip(place(keys), map(bytes, keys))])

    dealt = texts.select("doc_id", "order", "text", F.posexplode(parts_of(key)).alias("copied", "part"))
    return (dealt.repartition("part").sortWithinPartitions("part", "copied", F.desc("order"), "text")
            .select("part", (F.col("copied") > 0).alias("copied"), "doc_id", "text")
            .mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                        "edited_fingerprint string, near_edited double, near_next double"))


class Fingerprints:
    """Fingerprints held in a cell: which of them are alike enough."""

    def __init__(self, least: float):
        self.least = least

    def __call__(self, contents: list[bytes]) -> Fingerprints:
        out = Fingerprints(self.least)
        out.scales, out.bits = _unpacked(contents)
        return out

    def near(self, content: bytes) -> np.ndarray:
        scale, bits = _unpacked([content])
        n = len(self.scales)
        return likeness(self.scales, self.bits, np.repeat(scale, n), np.repeat(bits, n, axis=0)) >= self.least


def _unpacked(contents: list[bytes]):
    rows = np.frombuffer(b"".join(contents), np.uint8).reshape(len(contents), -1)
    return rows[:, 0].astype(np.int64), np.unpackbits(rows[:, 1:], axis=1)


def _least_reach(scale: int) -> int:
    """Steps that the walk of any text of a scale takes at least: two a character, less what chance allows."""
    n = (1 << scale >> 1) + 1 if scale else 1
    return max(n, int(1.9 * n - 7 * n ** 0.5))


def _choices(least: float, ratio: float) -> int:
    """Random choices that miss a pair alike by `least` no more often than BANDS of BAND_BITS bits would.

    A choice has up to BAND_BITS / ratio bits before the end of the longer text of a pair.
    """
    agree = (1 + min(max(least, 0.0), 0.99)) / 2
    wanted, got = np.log1p(-agree ** BAND_BITS), np.log1p(-agree ** (BAND_BITS / ratio))
    return int(min(np.ceil(BANDS * wanted / got), 8 * BANDS))


def _band_keys(scales: np.ndarray, bits: np.ndarray, least: float) -> list[list[int]]:
    """Bands of each text: texts alike by `least` or more have all bits of one of some random choices in common.

    A text has them at its own scale and at larger ones of which a text may be so like it. Behind the
    ends of both texts bits agree anyway, so a choice is the longer the fewer samples lie before the
    end. It depends on the class of their share; as the shares of two such texts are within `least`
    of each other, a text has the choices of its class and of the next.
    """
    ratio = min(max(least, 0.05), 0.9)
    sampled = sum(SHARES)
    bands = _choices(least, ratio)
    order = np.argsort(stream(43, bands * sampled).reshape(bands, sampled), axis=1)
    factor = stream(47, bands * sampled).reshape(bands, sampled) | U64(1)
    reach, keys = _reach(bits), [[] for _ in range(len(bits))]
    for scale in np.unique(scales).tolist():
        for up in range(len(SHARES)):
            steps, (slots, others) = _steps(scale + up)[:sampled], _shared_slots(up)
            own = np.flatnonzero(scales == scale)
            before = (steps < reach[own, None]).sum(axis=1)
            near = (before > 0) & ((up == 0) | (before >= least * (steps < _least_reach(scale + up)).sum()))
            if not near.any():
                break
            own, before = own[near], before[near]
            view = np.repeat(_coins(scale + up, np.full((1, BITS), END)), len(own), axis=0)
            view[:, others] = bits[own][:, slots]
            view = view[:, :sampled].astype(U64)
            kind = np.floor(np.log(before / sampled) / np.log(ratio) + 1e-9).astype(np.int64)
            for k in np.unique([kind, kind + 1]).tolist():
                rows = np.flatnonzero((kind == k) | (kind + 1 == k))
                size = min(int(BAND_BITS / min(1, ratio ** k)), sampled)
                weight = np.zeros((sampled, bands), U64)
                np.put_along_axis(weight, order[:, :size].T, factor[:, :size].T, axis=0)
                tag = mix(U64((scale + up) * 4096 + k) * U64(1 << 16) + np.arange(bands, dtype=U64))
                made = mix(mix(view[rows] @ weight) + tag).view(np.int64)
                for r, row in zip(own[rows].tolist(), made.tolist()):
                    keys[r] += row
    return keys


def _banded(least: float):
    def banded(batches):
        for batch in batches:
            texts, names, contents, keys = batch.column("text").to_pylist(), [], [], []
            first, held = 0, 0
            for k, text in enumerate(texts):
                held += len(text)
                if held >= BLOCK_CHARS or k == len(texts) - 1:
                    scales, bits = fingerprints(texts[first:k + 1])
                    first, held = k + 1, 0
                    names += as_text(scales, bits)
                    keys += _band_keys(scales, bits, least)
            contents = [bytes.fromhex(name) for name in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(contents, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "fingerprint", "content", "bands"])

    return banded


def alike(docs: DataFrame, least: float = 0.8, space: Workspace | None = None) -> DataFrame:
    """doc_id, fingerprint, group_id: smallest doc_id reachable over fingerprints alike by `least` or more.

    docs: doc_id, text; other columns are ignored. Documents with equal fingerprints are one class; of the
    others, those that agree in all bits of one of some random choices are verified, also if their
    lengths lie on two sides of a power of two. With `least` 0.8 a pair at 0.9 likeness shares no
    band with probability 1e-11, at 0.8 with 3e-5; below 0.6 misses grow. Null texts are empty; empty texts form
    one class. Rows without doc_id have no group. Repeated rows stay; an empty table gives no rows.
    """
    space = space or Workspace(docs.sparkSession, "edit-fingerprints")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = space.keep(texts.mapInArrow(
        _banded(least), "doc_id long, fingerprint string, content binary, bands array<long>"), "signed")
    classes = signed.filter("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    first = signed.withColumnRenamed("fingerprint", "own").join(
        classes, (F.col("own") == F.col("fingerprint")) & (F.col("doc_id") == F.col("id")))
    shared = space.keep(buckets(first.select(F.explode("bands").alias("bucket"), "id").distinct()), "shared")
    contents = first.select("id", "content").dropDuplicates(["id"])
    roots = grouped(space, shared, contents, Fingerprints(least))
    return signed.join(classes, "fingerprint", "left").join(roots, F.col("id") == F.col("node"), "left").select(
        "doc_id", "fingerprint",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "id")).alias("group_id"))
