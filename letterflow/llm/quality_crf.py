"""Document quality from a linear-chain conditional random field over its lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterflow.llm.tables import Workspace, bounded_sample, widened
from letterflow.llm.textcols import IDENTITY, blocks, rows_of, utf8, words

#: Labelled texts to learn from, at most: those with the smallest hashes of their id.
SAMPLE = 2_500
#: Lines of these texts together, at most: each takes about a kilobyte of the driver while it learns.
LINES = 1 << 18
STEPS = 60
RATE = 0.1
DECAY = 1e-3
#: A word is a repeat if it is one of so many words before it on its line.
LOOK_BACK = 8

#: Kinds of bytes whose share of a line is a feature.
_KINDS = ("upper", "digit", "mark", "odd", "pipe", "shout", "stop", "high")
_KIND = np.full(256, -1, np.int8)
_KIND[65:91] = 0
_KIND[48:58] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
_KIND[[ord(c) for c in "#$%&*@^~<>{}[]\\_=+"]] = 3
_KIND[ord("|")] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in ".,"]] = 6
_KIND[128:] = 7
OWN = len(_KINDS) + 6
FEATURES = 3 * OWN + 5


def line_features(raw: np.ndarray, at: np.ndarray):
    """Features of each line, its length in bytes, and where each row's lines begin.

    A line's own features are shares of byte kinds, its length, its words' length and how many of
    them are repeats; then come those of the lines before and after it, and whether it equals them.
    Lines end at newlines; an empty row has one empty line.
    """
    n = len(raw)
    stops = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([stops + 1, at[:-1]]))
    begin = begin[begin < n]
    empty = np.flatnonzero(at[1:] == at[:-1])
    begin = np.concatenate([begin, at[empty]])
    row = np.concatenate([
        np.searchsorted(at, begin[:len(begin) - len(empty)], "right") - 1, empty]).astype(np.int64)
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    first = np.searchsorted(row, np.arange(len(at)))
    end = np.empty(len(begin), np.int64)
    end[:-1] = np.where(row[1:] == row[:-1], begin[1:] - 1, at[row[:-1] + 1])
    if len(end):
        end[-1] = at[row[-1] + 1]
    ends_blank = (end > begin) & (raw[np.maximum(end - 1, 0)] == 10) if n else np.zeros(len(end), bool)
    end = np.where(ends_blank, end - 1, end)
    length = end - begin
    own = np.zeros((len(begin), OWN))
    kind = _KIND[raw]
    # capitals beyond ASCII of the Latin-1 block: 0xC3 and then 0x80 to 0x9E
    wide = np.zeros(n, bool)
    if n:
        wide[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    shares = np.maximum(length, 1)
    for k in range(len(_KINDS)):
        total = np.concatenate([[0], np.cumsum((kind == k) | wide if k == 0 else kind == k, dtype=np.int32)])
        own[:, k] = (total[end] - total[begin]) / shares
    hashed, word, _, _ = words(raw, at, IDENTITY)
    line = np.searchsorted(begin, word, "right") - 1 if len(begin) else np.zeros(0, np.int64)
    count = np.bincount(line, minlength=len(begin))
    repeat = np.zeros(len(hashed), bool)
    for k in range(1, LOOK_BACK + 1):
        same = (hashed[k:] == hashed[:-k]) & (line[k:] == line[:-k])
        repeat[k:] |= same
        if k == 1:
            own[:, 8] = np.bincount(line[k:], weights=same, minlength=len(begin)) / np.maximum(count, 1)
    own[:, 9] = np.bincount(line, weights=repeat, minlength=len(begin)) / np.maximum(count, 1)
    own[:, 10] = np.log1p(length)
    own[:, 11] = np.log1p(count)
    own[:, 12] = np.where(count > 0, length / np.maximum(count, 1), 0).clip(0, 40) / 10
    own[:, 13] = count == 0
    name = np.bincount(line, weights=(hashed >> np.uint64(20)).astype(np.float64), minlength=len(begin))
    before, after = np.zeros_like(own), np.zeros_like(own)
    near = row[1:] == row[:-1]
    before[1:][near] = own[:-1][near]
    after[:-1][near] = own[1:][near]
    edges = np.zeros((len(begin), 5))
    edges[:, 0] = 1
    edges[1:, 1] = near
    edges[:-1, 2] = near
    edges[1:, 3] = near & (name[1:] == name[:-1])
    edges[:-1, 4] = edges[1:, 3]
    return np.hstack([own, before, after, edges]).astype(np.float32), length, first


@dataclass
class Crf:
    """Weights of "good" against "bad", the chain's moves between them, and the last calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    moves: np.ndarray
    slope: float
    shift: float


def _lattice(first: np.ndarray):
    """Lines by their place in the row: for each place the lines there, longest rows first."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    places = int(count[0]) if len(count) else 0
    rows = np.searchsorted(-count, -np.arange(1, places + 1), "right")
    return begin, rows


def marginals(unary: np.ndarray, moves: np.ndarray, first: np.ndarray):
    """Chance of "good" for each line by forward and backward sums, of each move, and rows' log sums.

    unary: score of "good" for each line ("bad" has 0). moves[i, j]: score of j after i.
    """
    begin, rows = _lattice(first)
    m = np.exp(moves - moves.max())
    e = np.exp(np.stack([np.minimum(-unary, 0), np.minimum(unary, 0)], axis=1))  # divided by the larger
    forward, backward = np.ones((len(unary), 2)), np.ones((len(unary), 2))
    scale = np.ones(len(unary))
    last = None
    for t, r in enumerate(rows):
        at = begin[:r] + t
        a = e[at] if last is None else (last[:r] @ m) * e[at]
        scale[at] = a.sum(axis=1)
        last = a / scale[at][:, None]
        forward[at] = last
    for t in range(len(rows) - 2, -1, -1):
        at = begin[:rows[t + 1]] + t
        b = (e[at + 1] * backward[at + 1]) @ m.T
        backward[at] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    good = both[:, 1] / both.sum(axis=1)
    follow = np.ones(len(unary), bool)
    follow[first[:-1][np.diff(first) > 0]] = False
    two = np.flatnonzero(follow)
    pair = forward[two - 1][:, :, None] * m * (e[two] * backward[two])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return good, pair


def fit_crf(x: np.ndarray, length: np.ndarray, first: np.ndarray, label: np.ndarray) -> Crf:
    """Weights under which lines labelled as their documents are likeliest (Adam on the exact gradient).

    The calibration makes the length-weighted share of good lines the chance of label 1.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-5], scale[scale < 1e-6] = 0, 1
    z = (x - mean) / scale
    weight, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    y = np.repeat(label, np.diff(first)).astype(float)
    follow = np.ones(len(y), bool)
    follow[first[:-1]] = False
    seen = np.zeros((2, 2))
    same = y[follow].astype(int)
    seen[0, 0], seen[1, 1] = (same == 0).sum(), (same == 1).sum()
    # every document weighs the same, and so does either label
    share = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1)) / np.diff(first)
    each = np.repeat(share, np.diff(first))
    state = [np.zeros_like(weight), np.zeros_like(weight), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, STEPS + 1):
        good, pair = marginals(z @ weight, moves, first)
        grad_w = z.T @ ((y - good) * each) - DECAY * weight
        w2 = each[follow]
        real = np.zeros((2, 2))
        real[0, 0], real[1, 1] = w2[same == 0].sum(), w2[same == 1].sum()
        grad_m = real - (pair * w2[:, None, None]).sum(axis=0) - 10 * DECAY * moves
        for k, (value, grad) in enumerate(((weight, grad_w), (moves, grad_m))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * grad
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * grad ** 2
            value += RATE * (state[2 * k] / (1 - 0.9 ** step)) / (
                np.sqrt(state[2 * k + 1] / (1 - 0.99 ** step)) + 1e-8)
    good, _ = marginals(z @ weight, moves, first)
    raw = _logit(_aggregate(good, length, first))
    slope, shift = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -35, 35)))
        g, h = np.array([((label - p) * raw).sum(), (label - p).sum()]), p * (1 - p)
        hess = np.array([[(h * raw * raw).sum() + 1, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(hess, g - np.array([slope - 1, 0]))
        slope, shift = slope + move[0], shift + move[1]
        if np.abs(move).max() < 1e-9:
            break
    return Crf(mean, scale, weight, moves, float(slope), float(shift))


def _aggregate(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    size = length + 1.0
    row = rows_of(first)
    return np.bincount(row, good * size, len(first) - 1) / np.bincount(row, size, len(first) - 1)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def quality(crf: Crf | None, x: np.ndarray, length: np.ndarray, first: np.ndarray):
    """(score, chance of good for each line); without a model all are a half."""
    if crf is None:
        return np.full(len(first) - 1, 0.5), np.full(len(x), 0.5)
    good, _ = marginals(((x - crf.mean) / crf.scale) @ crf.weight, crf.moves, first)
    logit = crf.slope * _logit(_aggregate(good, length, first)) + crf.shift
    return 1 / (1 + np.exp(-np.clip(logit, -35, 35))), good


def _featured(batches):
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        xs, lengths, counts = [], [], []
        for a, b in blocks(at):
            x, length, first = line_features(raw[at[a]:at[b]], at[a:b + 1] - at[a])
            for k in range(b - a):
                xs.append(x[first[k]:first[k + 1]].tobytes())
                lengths.append(length[first[k]:first[k + 1]].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(xs, pa.binary()), pa.array(lengths, pa.binary()), batch.column("label")],
            names=["x", "length", "label"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES,
        space: Workspace | None = None) -> Crf | None:
    """Learn from docs (doc_id, text) and labels (doc_id, label: 0 or 1); rows without label are left out.

    The features of at most `sample` labelled texts with at most `lines` lines together, those with the
    smallest hashes of doc_id, come to the driver: about 200 bytes a line, and a kilobyte in all while it
    learns. A text of more than an eighth of `lines` is not learnt from. Repeated rows and ids count
    each. None if there is no text of one of the labels.
    """
    space = space or Workspace(docs.sparkSession, "quality")
    ends = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\n\r]", "")) + 1
    rows = (bounded_sample(docs, labels, sample, ends, lines, space)
            .mapInArrow(_featured, "x binary, length binary, label int").collect())
    label = np.array([r["label"] for r in rows])
    if len(set(label)) < 2:
        return None
    rows.sort(key=lambda r: (bytes(r["x"]), r["label"]))
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, FEATURES)
    length = [np.frombuffer(r["length"], np.int64) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(v) for v in length])])
    return fit_crf(x.astype(np.float64), np.concatenate(length), first, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, crf: Crf | None, lines: bool = False) -> DataFrame:
    """All columns of docs plus score (0 to 1; higher: label 1 likelier), with `lines` also line_good.

    line_good holds the chance of good of each line. Null and empty texts are one empty line.
    Columns named like the new ones are replaced.
    """
    docs = docs.drop("score", "line_good")

    def scored(batches):
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            scores, each, counts = [], [], [np.zeros(1, np.int64)]
            for a, b in blocks(at):
                x, length, first = line_features(raw[at[a]:at[b]], at[a:b + 1] - at[a])
                s, good = quality(crf, x, length, first)
                scores.append(s)
                if lines:
                    each.append(good)
                    counts.append(np.diff(first))
            out = [*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            if lines:
                out.append(pa.ListArray.from_arrays(
                    pa.array(np.cumsum(np.concatenate(counts)), pa.int32()),
                    pa.array(np.concatenate(each) if each else np.zeros(0))))
            yield pa.RecordBatch.from_arrays(
                out, names=[*batch.schema.names, "score", *["line_good"] * lines])

    return docs.mapInArrow(scored, widened(
        docs, score="double", **{"line_good": "array<double>"} if lines else {}))
