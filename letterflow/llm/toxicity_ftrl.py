"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterflow.llm.tables import Workspace, bounded_sample, utf8_bytes, widened
from letterflow.llm.textcols import LOWER_AZ, U64, blocks, mix, rows_of, utf8, words

#: Weights there can be; a feature's hash picks one.
BITS = 21
#: Labelled texts to learn from, at most: those with the smallest hashes of their id.
SAMPLE = 20_000
#: Bytes of these texts together, at most; a task holds up to eight bytes of features for each.
SAMPLE_BYTES = 1 << 26
PASSES = 3
ALPHA, BETA, L2 = 1.0, 1.0, 0.01
#: L1 is this many times the square root of the number of rows learnt from, as chance counts grow so.
L1_ROOT = 0.12
#: Word, pair, pair with one word between.
GAPS = (0, 1, 2)

#: ASCII punctuation parts words here as blanks do.
_FOLD = LOWER_AZ.copy()
_FOLD[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0x20


def features(raw: np.ndarray, at: np.ndarray):
    """Hashed features of each row's words: (row, index), with repeats."""
    hashed, _, _, first = words(_FOLD[raw], at)
    row = rows_of(first)
    rows, index = [], []
    for gap in GAPS:
        if gap == 0:
            value, own = hashed, row
        else:
            near = row[gap:] == row[:-gap]
            value = (hashed[:-gap] * U64(0x9E3779B97F4A7C15 + 2 * gap) + hashed[gap:])[near]
            own = row[gap:][near]
        rows.append(own)
        index.append((mix(value + U64(gap)) >> U64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(index)


def _each(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Distinct features of each row."""
    row, index = features(raw, at)
    key = np.sort((row << BITS) | index)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return np.split(key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(1, len(at) - 1)))


class Ftrl:
    """One pass at a time over rows of present features; z and n give each weight its own rate."""

    def __init__(self, l1: float):
        self.l1 = l1
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        # the last weight is the bias, which L1 leaves alone
        l1 = np.where(np.asarray(i) == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, index: np.ndarray, label: int) -> None:
        i = np.append(index, 1 << BITS)
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def _cut(logit: np.ndarray, label: np.ndarray) -> float:
    """Where to part the rows learnt from: the highest of the cuts with the best F1."""
    if not label.any() or label.all():
        return 0.0
    order = np.argsort(logit, kind="stable")
    right = np.cumsum(label[order][::-1])[::-1]
    f1 = 2 * right / (np.arange(len(label), 0, -1) + label.sum())
    k = int(np.flatnonzero(f1 >= f1.max() - 1e-9)[-1])
    return float(logit[order][max(k - 1, 0):k + 1].mean())


def _fit(batches):
    """Learn from all rows of the one task they are in; the weights that are not zero."""
    rows, labels = [], []
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        for a, b in blocks(at):
            rows += [x.astype(np.int32) for x in _each(raw[at[a]:at[b]], at[a:b + 1] - at[a])]
        labels += batch.column("label").to_pylist()
    model = Ftrl(L1_ROOT * np.sqrt(len(rows)))
    order = np.random.default_rng(5)
    for _ in range(PASSES):
        for k in order.permutation(len(rows)):
            model.learn(rows[k], labels[k])
    index = np.arange((1 << BITS) + 1)
    w = model.weights(index)
    w[-1] -= _cut(np.array([w[x].sum() + w[-1] for x in rows]), np.array(labels))
    kept = (w != 0) | (index == 1 << BITS)
    yield pa.RecordBatch.from_arrays(
        [pa.array([index[kept].astype(np.int32).tobytes()]), pa.array([w[kept].tobytes()])], names=["i", "w"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES,
        space: Workspace | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights that are not zero, by index; the last one is the bias.

    docs: doc_id, text. labels: doc_id, label (0 or 1); rows without label are left out. At most
    `sample` labelled texts of at most `sample_bytes` bytes together, those with the smallest hashes of
    doc_id, are learnt from in one task; a text of more than an eighth of that is not. Repeated rows and ids
    count each. At most 2 ** BITS + 1 weights come back, packed into one row. Without rows all weights
    are 0: every score is a half.
    """
    space = space or Workspace(docs.sparkSession, "toxicity")
    rows = (bounded_sample(docs, labels, sample, utf8_bytes(F.col("text")), sample_bytes, space).repartition(1)
            .sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
            .mapInArrow(_fit, "i binary, w binary").collect())
    if not rows:
        return np.array([1 << BITS]), np.zeros(1)
    return np.frombuffer(rows[0]["i"], np.int32).astype(np.int64), np.frombuffer(rows[0]["w"], float)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """All columns of docs plus score: the chance (0 to 1) that the text is toxic.

    Null and empty texts have the score of the bias alone. A feature counts once however often it
    occurs. A column named score is replaced.
    """
    index, weight = model
    bias = float(weight[index == 1 << BITS].sum())
    known = index < 1 << BITS
    index, weight = index[known], weight[known]
    docs = docs.drop("score")

    def scored(batches):
        table = np.zeros(1 << BITS, np.float32)
        table[index] = weight
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            out = []
            for a, b in blocks(at):
                row, i = features(raw[at[a]:at[b]], at[a:b + 1] - at[a])
                hit = table[i] != 0
                key = np.unique((row[hit] << BITS) | i[hit])
                total = np.bincount(
                    key >> BITS, weights=table[key & ((1 << BITS) - 1)], minlength=b - a) + bias
                out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))],
                names=[*batch.schema.names, "score"])

    return docs.mapInArrow(scored, widened(docs, score="double"))
