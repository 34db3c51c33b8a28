"""Benchmark passages in documents by the q-gram lemma, diagonal bands and banded alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterflow.llm.tables import utf8_bytes
from letterflow.llm.textcols import U64, blocks, utf8

#: Bytes of a q-gram.
Q = 8
#: Bytes of a pattern: an item up to this long is one; a longer one is cut into such, each half over the last.
WINDOW = 128
#: Bytes of a passage: of a longer item, passages that begin every STRIDE bytes, and the last one, are patterns, too.
PASSAGE, STRIDE = 64, 8
#: A verbatim excerpt of so many normalised bytes of an item is always found: it holds a whole passage.
SURELY = PASSAGE + STRIDE - 1
#: A pattern of so many bytes may have one edit for each.
BYTES_PER_EDIT = 12
#: Diagonals of a band; bands overlap by half, which holds all diagonals of one match.
BAND = 32
#: Texts are searched in windows that begin every STEP bytes and share OVERLAP, more than a match is long;
#: equal windows are searched once, so texts that repeat themselves or each other cost no more.
STEP, OVERLAP = 1792, 256
#: Pairs of a place in a text and one in an item that are held at once.
PAIRS = 1 << 21
#: Bytes of items searched in one pass over the documents.
ITEM_BYTES = 1 << 20
HITS = "doc_id long, item_id long, windows int, edits int, begin int, end int"

_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[[c for c in range(128) if chr(c).isalnum()]] = [ord(chr(c).lower()) for c in range(128) if chr(c).isalnum()]
_NORMAL[128:] = np.arange(128, 256)
_FACTOR, _BITS = U64(0x9E3779B97F4A7C15), 21
_COST = 1 << 20


def budget(length):
    """Edits a pattern may have: one for BYTES_PER_EDIT bytes, as far as they leave one of its q-grams whole."""
    return np.minimum(length // BYTES_PER_EDIT, np.maximum(length - Q, 0) // Q)


def least_shared(length):
    """Q-grams that a pattern shares with every text within its budget: each edit spoils at most Q."""
    return length - Q + 1 - Q * budget(length)


def normalise(raw: np.ndarray, at: np.ndarray):
    """Lower-case letters (ASCII and Latin-1), one blank for a run of other ASCII; what was kept."""
    out = _NORMAL[raw]
    lead = np.flatnonzero(raw == 0xC3) + 1
    if len(lead):
        lead = lead[lead < len(raw)]
        out[lead[(raw[lead] >= 0x80) & (raw[lead] <= 0x9E) & (raw[lead] != 0x97)]] += 0x20
    blank = out == 32
    keep = np.ones(len(out), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    begin = at[:-1][at[:-1] < len(out)]
    keep[begin] = True
    total = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return out[keep], total[at], keep


def _grams(text: np.ndarray) -> np.ndarray:
    padded = np.concatenate([text, np.zeros(Q, np.uint8)])
    return np.ndarray((len(text),), "<u8", padded, 0, (1,)).copy()


def _inside(at: np.ndarray) -> np.ndarray:
    """Where a q-gram begins that ends in the same row."""
    ok = np.zeros(at[-1], bool)
    for a, b in zip(at[:-1], at[1:]):
        ok[a:max(a, b - Q + 1)] = True
    return ok


def patterns(size: int) -> list[tuple[int, int]]:
    """Begin and length of each part of an item of so many bytes that makes it found."""
    if size < Q:
        return []
    starts = [0] if size <= WINDOW else {*range(0, size - WINDOW, WINDOW // 2), size - WINDOW}
    out = {(s, min(size, WINDOW)) for s in starts}
    if size > PASSAGE:
        out.update((s, PASSAGE) for s in (*range(0, size - PASSAGE, STRIDE), size - PASSAGE))
    return sorted(out)


class Index:
    """Q-grams and patterns of a bounded set of items."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, np.int64)
        raw, at = utf8(pa.array(texts, pa.string()))
        text, at, _ = normalise(raw, at)
        # blanks at the ends of an item are no part of it
        rows = [text[a:b].tobytes().strip(b" ") for a, b in zip(at[:-1], at[1:])]
        self.text = np.frombuffer(b"".join(rows), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.patterns = []
        for size in np.diff(self.at):
            self.patterns.append(patterns(int(size)))
        lengths = np.array([min((n for _, n in p), default=0) for p in self.patterns])
        self.least = np.where(lengths > 0, least_shared(lengths), 1 << 60)
        where = np.flatnonzero(_inside(self.at))
        grams = _grams(self.text)[where]
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(grams))
        self.place = where[order].astype(np.int32)
        self.item = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(self.at))
        self.longest = int(np.diff(self.at).max()) if len(rows) else 0
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.grams * _FACTOR) >> U64(64 - _BITS)] = True

    def search(self, raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, windows, edits, begin, end) of every item found in a row; begin and end in bytes."""
        text, begin, keep = normalise(raw, at)
        if not len(self.grams) or not len(text):
            return []
        windows: dict[bytes, list[tuple[int, int]]] = {}
        for r, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
            for start in range(a, max(a + 1, b - OVERLAP), STEP):
                windows.setdefault(text[start:min(start + STEP + OVERLAP, b)].tobytes(), []).append((r, start))
        found = self._found(list(windows))
        best: dict[tuple[int, int], dict[tuple[int, int], tuple[int, int, int]]] = {}
        for (w, i), parts in found.items():
            for r, start in windows[w]:
                own = best.setdefault((r, i), {})
                for part, (edits, b, e) in parts.items():
                    here = edits, start + b, start + e
                    own[part] = min(own.get(part, here), here)
        if not best:
            return []
        back = np.flatnonzero(keep)
        out = []
        for (r, i), parts in sorted(best.items()):
            b, e = min(p[1] for p in parts.values()), max(p[2] for p in parts.values())
            first = back[min(max(b, begin[r]), begin[r + 1] - 1)] - at[r]
            last = back[min(max(e, b + 1), begin[r + 1]) - 1] + 1 - at[r]
            out.append((r, i, len(parts), int(sum(p[0] for p in parts.values())), int(first), int(last)))
        return out

    def _found(self, windows: list[bytes]) -> dict[tuple[bytes, int], dict[tuple[int, int], tuple[int, int, int]]]:
        """Of each window and item found in it: fewest edits, begin and end of each pattern that is there."""
        text = np.frombuffer(b"".join(windows), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(w) for w in windows])]).astype(np.int64)
        hits, span = self._hits(text, begin)
        if not len(hits):
            return {}
        # distinct places of items that a half-band of diagonals holds, by window, item and half-band
        band, place = hits // len(self.text), hits % len(self.text)
        item = self.item[place]
        key = (band // span * len(self.ids) + item) * span + band % span
        order = np.argsort(key, kind="stable")
        key, place = key[order], (place - self.at[item])[order]
        halves, first, n = np.unique(key, return_index=True, return_counts=True)
        first = np.append(first, len(key))
        # bands k and k + 1 of half their width both hold the half-band k + 1
        total = n.copy()
        follows = (halves[1:] == halves[:-1] + 1) & (halves[1:] % span != 0)
        total[:-1][follows] += n[1:][follows]
        follows = np.append(follows, False)
        candidates = []
        for h in np.flatnonzero(total >= self.least[halves // span % len(self.ids)]).tolist():
            own = np.unique(place[first[h]:first[h + 2 if follows[h] else h + 1]])
            pair, half = divmod(int(halves[h]), span)
            w, i = divmod(pair, len(self.ids))
            for start, length in self.patterns[i]:
                shared = np.searchsorted(own, start + length - Q + 1) - np.searchsorted(own, start)
                if shared >= least_shared(length):
                    candidates.append((w, i, start, length, half * (BAND // 2) - self.longest))
        out: dict[tuple[bytes, int], dict[tuple[int, int], tuple[int, int, int]]] = {}
        for low in range(0, len(candidates), 512):
            some = candidates[low:low + 512]
            for (w, i, start, length, _), (edits, b, e) in zip(some, self._align(some, text, begin)):
                if edits is not None:
                    parts, here = out.setdefault((windows[w], i), {}), (edits, b - int(begin[w]), e - int(begin[w]))
                    parts[start, length] = min(parts.get((start, length), here), here)
        return out

    def _hits(self, text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, int]:
        """Distinct (window, half-band of diagonals, place in the items) that share a q-gram, and half-bands of a window.

        Places are joined PAIRS at a time, of which only distinct ones are kept.
        """
        span = (STEP + OVERLAP + self.longest) // (BAND // 2) + 2
        grams = _grams(text)
        where = np.flatnonzero(self.seen[(grams * _FACTOR) >> U64(64 - _BITS)])
        row = np.searchsorted(begin, where, "right") - 1
        fits = where + Q <= begin[row + 1]
        where, row = where[fits], row[fits]
        gram = np.searchsorted(self.grams, grams[where])
        known = self.grams[np.minimum(gram, len(self.grams) - 1)] == grams[where]
        where, row, gram = where[known], row[known], gram[known]
        count = self.first[gram + 1] - self.first[gram]
        upto, out, low = np.cumsum(count), [np.zeros(0, np.int64)], 0
        while low < len(where):
            before = upto[low] - count[low]
            high = max(low + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
            each = np.repeat(np.arange(low, high), count[low:high])
            posting = np.arange(len(each)) - (upto - count)[each] + before + self.first[gram[each]]
            place = self.place[posting].astype(np.int64)
            diagonal = where[each] - begin[row[each]] - (place - self.at[self.item[place]]) + self.longest
            out.append(np.unique((row[each] * span + diagonal // (BAND // 2)) * len(self.text) + place))
            low = high
        return (np.unique(np.concatenate(out)) if len(out) > 2 else out[-1]), span

    def _align(self, candidates, text, begin):
        """Fewest edits of each pattern anywhere in its band, with begin and end in the text, or None."""
        n = len(candidates)
        rows, items, starts, lengths, diagonals = (np.array(x) for x in zip(*candidates))
        slack = budget(WINDOW)
        width, most = BAND + 2 * slack + 1, int(lengths.max())
        column = np.arange(width)
        base = begin[rows] + starts + diagonals - slack
        at = base[:, None] + np.arange(most + width)
        segment = np.where((at >= begin[rows][:, None]) & (at < begin[rows + 1][:, None]),
                           text[np.clip(at, 0, len(text) - 1)], 0)
        at = (self.at[items] + starts)[:, None] + np.arange(most)
        pattern = self.text[np.minimum(at, len(self.text) - 1)]
        cost = np.broadcast_to(column.astype(np.int64), (n, width)).copy()
        best = np.full((n, 3), -1, np.int64)
        ramp = column * _COST
        for i in range(1, most + 1):
            now = cost + (segment[:, i - 1:i - 1 + width] != pattern[:, i - 1:i]) * _COST
            now[:, :-1] = np.minimum(now[:, :-1], cost[:, 1:] + _COST)
            cost = np.minimum.accumulate(now - ramp, axis=1) + ramp
            ends = np.flatnonzero(lengths == i)
            if len(ends):
                k = cost[ends].argmin(axis=1)
                value = cost[ends, k]
                best[ends] = np.stack([value // _COST, base[ends] + value % _COST, base[ends] + i + k], axis=1)
        return [(int(c), int(b), int(e)) if c <= budget(length) else (None, 0, 0)
                for (c, b, e), length in zip(best, lengths)]


def indexes(benchmark: DataFrame) -> list[tuple[list[int], list[str]]]:
    """Items in sets of bounded size: equal texts once, by their smallest item_id; null texts left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    total = items.agg(F.sum(utf8_bytes(F.col("text"))).alias("n")).first()["n"] or 0
    sets = -(-total // ITEM_BYTES)
    for k in range(sets):
        rows = sorted(items.filter(F.pmod(F.xxhash64("text"), F.lit(sets)) == k).collect(), key=lambda r: (
            r["item_id"] is None, r["item_id"], r["text"]))
        if rows:
            yield [r["item_id"] if r["item_id"] is not None else -1 for r in rows], [r["text"] for r in rows]


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and each benchmark item found in it.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Returns doc_id, item_id,
    windows (patterns of the item found), edits (theirs together), begin and end (code points of the
    text, end left out). An item is found if one of its patterns lies in the normalised text with at
    most one edit for every BYTES_PER_EDIT bytes. Patterns overlap: WINDOW bytes, or the whole of a
    shorter item, and the passages of PASSAGE bytes at every STRIDE of an item that is longer than
    one. So any verbatim excerpt of SURELY normalised bytes is found wherever it begins, and a
    shorter one of PASSAGE bytes or more if a passage begins early enough in it; an item of up to
    PASSAGE bytes is found as a whole only, and one of fewer than 2 * Q bytes without any edit.

    The benchmark is the query set: it is read in sets of at most about ITEM_BYTES, and all documents
    are searched for each. No match within the budget is lost: it shares at least `least_shared`
    q-grams with its pattern, on diagonals that lie in one band, and only bands with as many are
    aligned. Very long texts are searched in windows, and memory doesn't grow with how often a text
    or item repeats a q-gram. Null and empty texts have no matches; items with equal texts are one, by
    the smallest item_id (-1 if that is null); items of fewer than Q bytes can't be found. Repeated
    rows give repeated rows. Empty tables give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], HITS)
    for ids, items in indexes(benchmark):
        out = out.unionAll(texts.mapInArrow(_finder(ids, items), HITS))
    return out


def _finder(ids: list[int], items: list[str]):
    def found(batches):
        index = Index(ids, items)
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            doc = batch.column("doc_id")
            hits = []
            for a, b in blocks(at):
                own = raw[at[a]:at[b]]
                lead = (own & 0xC0) != 0x80
                for r, i, windows, edits, begin, end in index.search(own, at[a:b + 1] - at[a]):
                    first = at[a + r] - at[a]
                    before = int(lead[first:first + begin].sum())
                    hits.append((a + r, int(index.ids[i]), windows, edits, before,
                                 before + int(lead[first + begin:first + end].sum())))
            row, *rest = zip(*hits) if hits else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(row, pa.int64())), pa.array(rest[0], pa.int64()),
                 *[pa.array(x, pa.int32()) for x in rest[1:]]],
                names=["doc_id", "item_id", "windows", "edits", "begin", "end"])

    return found


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns; no row is moved.

    Null and empty texts stay. Repeated rows stay or go together. Without items all rows stay; an empty
    table gives none.
    """
    for ids, items in indexes(benchmark):
        docs = docs.mapInArrow(_remover(ids, items), docs.schema)
    return docs


def _remover(ids: list[int], items: list[str]):
    def clean(batches):
        index = Index(ids, items)
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            keep = np.ones(len(batch), bool)
            for a, b in blocks(at):
                for r, *_ in index.search(raw[at[a]:at[b]], at[a:b + 1] - at[a]):
                    keep[a + r] = False
            yield batch.filter(pa.array(keep))

    return clean
