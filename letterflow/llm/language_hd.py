"""Language identification by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterflow.llm.tables import unused, widened
from letterflow.llm.textcols import U64, blocks, mix, rows_of, utf8

#: Dimensions of all vectors.
DIM = 1024
#: Trigrams worked on at once.
GRAMS = 4096
#: Learned languages whose prototypes fit every task: at most so many.
LANGUAGES = 4096
#: Prototypes are sums of whole numbers, which don't depend on the order of rows.
UNIT = 1 << 20
UNKNOWN = "und"
#: A text of SHORT letters or more whose cosines are all below ALIEN is in no language learnt: texts of 100
#: letters in their own language have 0.24 and more in the test tables, other languages, codes and random
#: letters 0.14 and less.
ALIEN, SHORT = 0.15, 100


_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Lower-case letter of each code point up to 0xFFFF; 0 for what is no letter."""
    if "letters" in _tables:
        return _tables["letters"]
    table = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    _tables["letters"] = table
    return table


def _letter_codes(raw: np.ndarray) -> np.ndarray:
    code = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    out = _letters()[np.minimum(code, 0xFFFF)]
    for c in np.unique(code[code > 0xFFFF]):
        out[code == c] = c if chr(c).isalpha() else 0
    return out


def _letter_vectors(codes: np.ndarray) -> np.ndarray:
    """A random vector of -1 and 1 for each letter, the same in every task."""
    word = np.arange(DIM // 64, dtype=U64) * U64(0x9E3779B97F4A7C15)
    bits = mix(mix(codes.astype(U64) + U64(77))[:, None] + word)
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def trigrams(raw: np.ndarray, at: np.ndarray):
    """Letters seen, and trigrams of each row as numbers over them; runs of other characters are one 0.

    Each row is taken as if such a run stood before and after it; a row without letters has none.
    """
    lead = np.ones(len(raw), bool) if not len(raw) else (raw & 0xC0) != 0x80
    begin = np.concatenate([[0], np.cumsum(lead)])[at]
    code = _letter_codes(raw)
    n = len(at) - 1
    # one boundary before each row and one after the last
    row = rows_of(begin)
    padded = np.zeros(len(code) + n + 1, np.uint32)
    padded[np.arange(len(code)) + row + 1] = code
    owner = np.empty(len(padded), np.int64)
    owner[np.arange(len(code)) + row + 1] = row
    owner[begin[:-1] + np.arange(n)] = np.arange(n)
    owner[-1] = n
    keep = padded > 0
    keep[1:] |= padded[:-1] > 0
    keep[begin + np.arange(n + 1)] = True
    padded, owner = padded[keep], owner[keep]
    letters, at_letter = _alphabet(padded)
    size = np.int64(len(letters))
    one, two, three = at_letter[:-2], at_letter[1:-1], at_letter[2:]
    gram = (one * size + two) * size + three
    mine = (owner[:-2] == owner[1:-1]) & ((owner[2:] == owner[1:-1]) | (three == 0)) & (two > 0)
    # the first letter of a row has its boundary before it, a row's last letter the next row's
    return letters, gram[mine], owner[1:-1][mine], n


def _alphabet(code: np.ndarray):
    if not len(code) or code.max() <= 0xFFFF:
        seen = np.zeros(1 << 16, bool)
        seen[code] = True
        seen[0] = True
        letters = np.flatnonzero(seen).astype(np.uint32)
        place = np.zeros(1 << 16, np.int64)
        place[letters] = np.arange(len(letters))
        return letters, place[code]
    letters = np.unique(np.append(code, np.uint32(0)))
    return letters, np.searchsorted(letters, code)


def document_vectors(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bundle of the trigram vectors of each row, rows x DIM."""
    return _bundles(raw, at)[0]


def _bundles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bundle of the trigram vectors of each row, and its letters.

    The vector of a trigram binds its letters: the product of the first one's vector permuted twice,
    the second one's permuted once, and the third one's.
    """
    letters, gram, row, n = trigrams(raw, at)
    out = np.zeros((n, DIM), np.float32)
    size = len(letters)
    if size ** 3 <= 1 << 22:
        seen = np.zeros(size ** 3, bool)
        seen[gram] = True
        kinds = np.flatnonzero(seen)
        place = np.zeros(size ** 3, np.int64)
        place[kinds] = np.arange(len(kinds))
        gram = place[gram]
    else:
        kinds, gram = np.unique(gram, return_inverse=True)
    third = _letter_vectors(letters)
    second, first = np.roll(third, 1, axis=1), np.roll(third, 2, axis=1)
    for low in range(0, len(kinds), GRAMS):
        own = kinds[low:low + GRAMS]
        bound = first[own // size ** 2] * second[own // size % size] * third[own % size]
        inside = slice(None) if len(kinds) <= GRAMS else (gram >= low) & (gram < low + GRAMS)
        counts = np.bincount(row[inside] * len(own) + gram[inside] - low, minlength=n * len(own))
        out += counts.reshape(n, len(own)).astype(np.float32) @ bound.astype(np.float32)
    return out, np.bincount(row, minlength=n)


def _of_length_one(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros(vectors.shape), where=length > 0)


def _units(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _of_length_one(document_vectors(raw, at))


def _bundled(batches):
    """Sum of the documents' unit vectors of each language in a partition."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for a, b in blocks(at):
            whole = np.rint(_units(raw[at[a]:at[b]], at[a:b + 1] - at[a]) * UNIT).astype(np.int64)
            for lang in set(langs[a:b]):
                total[lang] = total.get(lang, 0) + whole[langs[a:b] == lang].sum(axis=0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.string()),
         pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "vector"])


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototype of each language: the bundle of its documents' unit vectors, of length 1.

    docs: text, lang. Rows without lang are left out. Vectors are summed in each partition and then
    for each dimension; only languages x DIM numbers reach the driver. No rows give no prototypes.
    """
    sums = (docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
            .filter("lang is not null").mapInArrow(_bundled, "lang string, vector array<long>")
            .select("lang", F.posexplode("vector").alias("d", "v"))
            .groupBy("lang", "d").agg(F.sum("v").alias("v")))
    packed = sums.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("v"))
    rows = packed.limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    out = {}
    for row in sorted(rows, key=lambda r: r["lang"]):
        v = np.array(row["v"], np.float64)
        if v.any():
            out[row["lang"]] = (v / np.sqrt((v ** 2).sum())).astype(np.float32)
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """All columns of docs plus lang_pred and score, the cosine with the nearest prototype (0 to 1).

    Text without a letter, null text, or no prototype at all give `und` with score 0. Equal cosines
    go to the first language in order. Columns named like the new ones are replaced.
    """
    names = list(prototypes)
    table = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), DIM)
    docs = docs.drop("lang_pred", "score")

    def scored(batches):
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            langs, scores = [], []
            for a, b in blocks(at):
                unit = _units(raw[at[a]:at[b]], at[a:b + 1] - at[a])
                cosine = unit @ table.T if names else np.zeros((b - a, 1))
                known = unit.any(axis=1) & bool(names)
                best = cosine.argmax(axis=1)
                langs += [names[k] if ok else UNKNOWN for k, ok in zip(best, known)]
                top = cosine[np.arange(b - a), best]
                scores.append(np.where(known, np.clip(top, 0, 1), 0.0))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(score)],
                names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(scored, widened(docs, lang_pred="string", score="double"))


def recognised(docs: DataFrame, least: float = ALIEN, letters: int = SHORT) -> DataFrame:
    """The documents in a language learnt from those with lang; all their columns, none added or replaced.

    Rejected are texts without a letter (null and empty ones, too), which `predict` calls `und`, and
    texts of `letters` letters or more whose cosine with every prototype is below `least`: languages
    not learnt, and strings that are no language. Shorter texts with a letter stay, as their cosines are
    mostly chance. With no lang at all only texts without letters are rejected. Repeated rows
    are judged alike; an empty table gives no rows.
    """
    prototypes = learn(docs)
    table = np.array(list(prototypes.values()), np.float32).reshape(len(prototypes), DIM)
    text = unused(docs, "text")[0]

    def judged(batches):
        for batch in batches:
            raw, at = utf8(batch.column(text))
            keep = [np.zeros(0, bool)]
            for a, b in blocks(at):
                vectors, seen = _bundles(raw[at[a]:at[b]], at[a:b + 1] - at[a])
                near = (_of_length_one(vectors) @ table.T >= least).any(axis=1) if len(table) else seen > 0
                keep.append((seen > 0) & (near | (seen < letters)))
            yield batch.filter(pa.array(np.concatenate(keep))).drop_columns([text])

    # the text as a string, whatever its type or the case of its name
    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(judged, docs.schema)
