"""Words, shingles and signatures against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from letterflow.llm import superminhash, textcols

TEXTS = ["", " ", "one", "One two", "a b c d e", "a b c d e f a b c d e f", "x\ty\nz\x0b\x0c\r q", "Été à l'île " * 9,
         "word " * 40, " stays inside", "😀 ok " * 7]


def python_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def python_set(text):
    words = python_words(text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def sets_of(texts):
    raw, at = textcols.utf8(pa.array(texts, pa.string()))
    hashed, _, _, first = textcols.words(raw, at)
    return textcols.distinct(*textcols.shingles(hashed, first))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=6))
def test_word_counts(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    raw, at = textcols.utf8(pa.array(texts, pa.string()))
    _, begin, end, first = textcols.words(raw, at)
    got = [[raw[b:e].tobytes().decode().translate({i: i + 32 for i in range(65, 91)})
            for b, e in zip(begin[a:z], end[a:z])] for a, z in zip(first[:-1], first[1:])]
    assert got == [python_words(t or "") for t in texts]


def test_sets_and_their_overlap():
    elements, begin = sets_of(TEXTS)
    sets = [set(elements[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:])]
    wanted = [python_set(t) for t in TEXTS]
    assert [len(s) for s in sets] == [len(w) for w in wanted]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert len(a & b) == len(wanted[i] & wanted[j])


def test_a_short_sequence_is_not_a_shingle():
    one, two = sets_of(["a b c d"]), sets_of(["a b c d e"])
    assert one[0][0] != two[0][0]


def slow_signature(elements, slots):
    """SuperMinHash with no early stop, one element at a time."""
    best = [float("inf")] * slots
    for x in elements:
        order = list(range(slots))
        for j in range(slots):
            drawn = int(textcols.mix(np.array([x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64))[0])
            k = j + (((drawn >> 32) * (slots - j)) >> 32)
            order[j], order[k] = order[k], order[j]
            best[order[j]] = min(best[order[j]], (j << 32) | (drawn & 0xFFFFFFFF))
    return best


@pytest.mark.parametrize("n", [1, 3, 40])
def test_early_stop_changes_nothing(n):
    elements = textcols.stream(n, n)
    with np.errstate(over="ignore"):
        got = superminhash.signatures(elements, np.array([0, n]), 16)[0].tolist()
        assert got == slow_signature(elements, 16)


def test_agreement_estimates_similarity():
    pool = textcols.stream(3, 400)
    elements = np.concatenate([pool[:300], pool[100:]])
    a, b = superminhash.signatures(elements, np.array([0, 300, 600]), 1024 // 8)
    assert abs((a == b).mean() - 0.5) < 0.15


def test_rows_without_elements():
    signature = superminhash.signatures(np.zeros(0, np.uint64), np.array([0, 0]))
    assert (signature == np.iinfo(np.uint64).max).all()
