"""Near-duplicate groups against brute force."""

import random

import pytest

from letterflow.llm import cells, superminhash
from tests.llm.test_text_signatures import python_set

SCHEMA = "doc_id long, text string, source string, n_shingles string, id long, bucket int"


def brute(rows):
    sets = {d: python_set(t or "") for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def varied(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(7)
    texts = [" ".join(f"v{rng.randrange(200)}" for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    base = " ".join(f"u{rng.randrange(900)}" for _ in range(100))
    texts += [varied(rng, base, rng.randrange(1, 5)) for _ in range(120)]
    chain = base
    for _ in range(12):
        chain = varied(rng, chain, 3)
        texts.append(chain)
    texts += [texts[50]] * 30 + ["", " ", None, "same", "Same", "a b c d e", "A b c d E"]
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


@pytest.mark.parametrize("block, salt", [(256, 2048), (8, 4)])
def test_groups_equal_brute_force(spark, monkeypatch, block, salt):
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "SALT", salt)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "s", "clash", 1, 2) for d, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in superminhash.near_duplicates(docs).collect()}
    want = brute(rows)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_nulls_and_repeated_rows(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame(
        [(None, text, None, None, None, None), (3, text, None, None, None, None), (3, text, None, None, None, None),
         (4, text, None, None, None, None), (9, None, None, None, None, None)], SCHEMA)
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"])
                 for r in superminhash.near_duplicates(docs).collect())
    # a row without doc_id is linked like others and names no component
    assert got == [(-1, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (9, 0, 9, True)]
    kept = superminhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [3, 9]


def test_texts_of_one_doc_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    near = b.replace("b20", "x")
    rows = [(1, a), (1, b), (1, b), (2, near), (None, c), (None, c), (None, c + " end"), (5, a), (6, ""), (6, ""), (None, " ")]
    docs = spark.createDataFrame([(d, t, "s", "clash", 1, 2) for d, t in rows], SCHEMA).repartition(3)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in superminhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 1, True)] * 3 + [(2, 1, False), (5, 1, False)] + [(None, None, True)] * 4 + [(6, 6, True)] * 2, key=repr)
    kept = sorted(((r["doc_id"], r["text"]) for r in superminhash.keep_one(docs).collect()), key=repr)
    assert len([t for _, t in kept if t and t.startswith("c0")]) == 1
    assert [r for r in kept if not (r[1] or "").startswith("c0")] == sorted(
        [(1, a), (1, b), (6, ""), (6, ""), (None, " ")], key=repr)


def test_keep_one_keeps_columns_of_any_name(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(1, text, 7, 8, 9), (2, text, 7, 8, 9)],
                                 "doc_id long, text string, _kept int, _key int, __KEY int")
    assert [tuple(r) for r in superminhash.keep_one(docs).collect()] == [(1, text, 7, 8, 9)]


def test_very_long_text(spark):
    text = " ".join(f"w{k}" for k in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "ha " * 300_000)], "doc_id long, text string")
    got = sorted(map(tuple, superminhash.near_duplicates(docs).collect()))
    assert got == [(1, 199_996, 1, True), (2, 199_997, 1, False), (3, 1, 3, True)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert superminhash.near_duplicates(docs).collect() == []
    assert superminhash.keep_one(docs).collect() == []
