"""Hashed features and FTRL weights."""

import random

import numpy as np
import pyarrow as pa

from letterflow.llm import textcols, toxicity_ftrl

SCHEMA = "doc_id long, text string, score string, label int"


def each(texts):
    raw, at = textcols.utf8(pa.array(texts, pa.string()))
    return [set(x.tolist()) for x in toxicity_ftrl._each(raw, at)]


def test_features_are_words_pairs_and_skip_pairs():
    whole, other, empty, none = each(["a b c", "A, b. (c)", "", None])
    assert len(whole) == 6  # a, b, c, ab, bc, a_c
    assert whole == other and not empty and not none
    assert len(each(["a a a a"])[0]) == 3


def test_pairs_stay_in_their_row():
    together = each(["a b", "c d"])
    assert together == [each(["a b"])[0], each(["c d"])[0]]


def plain_ftrl(rows, labels, l1):
    z, n = {}, {}

    def weight(i):
        bound = 0 if i == "bias" else l1
        if abs(z.get(i, 0)) <= bound:
            return 0.0
        return (np.sign(z[i]) * bound - z[i]) / (
            (toxicity_ftrl.BETA + np.sqrt(n[i])) / toxicity_ftrl.ALPHA + toxicity_ftrl.L2)

    for row, label in zip(rows, labels):
        w = {i: weight(i) for i in [*row, "bias"]}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in w:
            old = n.get(i, 0)
            z[i] = z.get(i, 0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / toxicity_ftrl.ALPHA * w[i]
            n[i] = old + g * g
    return weight


def test_updates_equal_the_plain_rule():
    rng = random.Random(5)
    rows = [rng.sample(range(30), rng.randrange(0, 6)) for _ in range(200)]
    labels = [int(3 in r or rng.random() < 0.1) for r in rows]
    model = toxicity_ftrl.Ftrl(0.5)
    for r, y in zip(rows, labels):
        model.learn(np.array(r, np.int64), y)
    weight = plain_ftrl(rows, labels, 0.5)
    assert np.allclose(model.weights(np.arange(30)), [weight(i) for i in range(30)])
    assert np.isclose(model.weights(np.array([1 << toxicity_ftrl.BITS]))[0], weight("bias"))


def planted(n, start=0):
    rng = random.Random(n)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(start, start + n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        bad = k % 8 == 0
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "scum"]))
        rows.append((k, " ".join(text), None, int(bad)))
    return rows


def test_finds_planted_words_and_stays_sparse(spark):
    docs = spark.createDataFrame(planted(800), SCHEMA)
    model = toxicity_ftrl.fit(docs, docs.select("doc_id", "label"))
    assert len(model[0]) < 200
    fresh = spark.createDataFrame(planted(200, 10_000) + [(None, None, None, None), (1, "", None, None),
                                                          (2, "fine " * 50_000 + "scum", None, 1)], SCHEMA)
    scored = toxicity_ftrl.score(fresh, model)
    assert scored.columns == ["doc_id", "text", "label", "score"]
    for r in scored.collect():
        assert (r["score"] >= 0.5) == (r["label"] == 1)
    again = toxicity_ftrl.fit(docs.repartition(3), docs.select("doc_id", "label"))
    assert np.array_equal(again[0], model[0]) and np.allclose(again[1], model[1])


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = toxicity_ftrl.fit(none, none.select("doc_id", "label"))
    assert toxicity_ftrl.score(none, model).collect() == []
    one = spark.createDataFrame([(1, "x", None, None)], SCHEMA)
    assert toxicity_ftrl.score(one, model).first()["score"] == 0.5
