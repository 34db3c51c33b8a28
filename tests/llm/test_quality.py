"""Line features, the chain's sums and the quality of documents."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from letterflow.llm import quality_crf, textcols
from letterflow.llm.tables import Workspace, bounded_sample

SCHEMA = "doc_id long, text string, score string, label int"


def features(texts):
    raw, at = textcols.utf8(pa.array(texts, pa.string()))
    return quality_crf.line_features(raw, at)


def test_lines_of_each_row():
    texts = ["a\nb", "", "one line", "\n", "end\n", None, "x\n\ny"]
    _, length, first = features(texts)
    lines = [length[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert lines == [[1, 1], [0], [8], [0], [3], [0], [1, 0, 1]]


def test_rows_do_not_touch():
    texts = ["Ab cd | x!\nsame\nsame", "", "ÉÉ É\nq"]
    whole, _, first = features(texts)
    for k, text in enumerate(texts):
        alone, _, _ = features([text])
        assert np.allclose(whole[first[k]:first[k + 1]], alone)


def brute(unary, moves):
    weights = {}
    for path in itertools.product((0, 1), repeat=len(unary)):
        score = sum(u for u, s in zip(unary, path) if s) + sum(moves[a, b] for a, b in zip(path, path[1:]))
        weights[path] = np.exp(score)
    total = sum(weights.values())
    return [sum(w for p, w in weights.items() if p[t]) / total for t in range(len(unary))]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    sizes = [1, 5, 3, 1, 6]
    first = np.concatenate([[0], np.cumsum(sizes)])
    unary, moves = rng.normal(size=first[-1]) * 3, rng.normal(size=(2, 2))
    good, pair = quality_crf.marginals(unary, moves, first)
    for a, b in zip(first[:-1], first[1:]):
        assert np.allclose(good[a:b], brute(unary[a:b], moves))
    assert len(pair) == sum(n - 1 for n in sizes) and np.allclose(pair.sum(axis=(1, 2)), 1)


def test_extreme_scores_stay_finite():
    good, _ = quality_crf.marginals(np.array([900.0, -900.0, 0.0]), np.zeros((2, 2)), np.array([0, 3]))
    assert np.allclose(good, [1, 0, 0.5])


@pytest.fixture(scope="module")
def learnt(spark):
    rng = random.Random(3)
    prose = lambda: "\n".join(" ".join(rng.choice(["the", "of", "river", "tree", "grows"]) for _ in range(9)) + "."
                              for _ in range(rng.randrange(1, 5)))
    junk = lambda: "\n".join(rng.choice(["BUY!! NOW!! ", "x### y$$$ z%%% ", "a | b | c | "]) * 5 for _ in range(3))
    rows = [(k, prose() if k % 3 else junk(), None, int(k % 3 > 0)) for k in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA)
    return rows, quality_crf.fit(docs, docs.select("doc_id", "label"))


def test_learns_from_neighbouring_lines(spark, learnt):
    rows, crf = learnt
    docs = spark.createDataFrame(rows, SCHEMA)
    scored = quality_crf.score(docs, crf, lines=True)
    assert scored.columns == ["doc_id", "text", "label", "score", "line_good"]
    for r in scored.collect():
        assert (r["score"] >= 0.5) == (r["label"] == 1)
        assert len(r["line_good"]) == r["text"].count("\n") + 1


def test_nulls_empty_long_and_repeated(spark, learnt):
    long = "The river grows. " * 30_000
    docs = spark.createDataFrame([(None, None, None, None), (1, "", None, None), (1, "", None, None),
                                  (2, long, None, None)], SCHEMA)
    scores = {(r["doc_id"], len(r["text"] or "")): r["score"] for r in quality_crf.score(docs, learnt[1]).collect()}
    assert scores[None, 0] == scores[1, 0] and all(0 <= s <= 1 for s in scores.values())


def test_empty_tables_and_one_label(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality_crf.fit(none, none.select("doc_id", "label")) is None
    assert quality_crf.score(none, None).collect() == []
    one = spark.createDataFrame([(1, "a", None, 1)], SCHEMA)
    assert quality_crf.fit(one, one.select("doc_id", "label")) is None
    assert quality_crf.score(one, None).first()["score"] == 0.5


def test_sample_is_a_bound(spark, learnt):
    """On rows and on cost, with repeated rows, repeated ids and a text beyond it."""
    space = Workspace(spark, "test-sample")
    many = learnt[0] + [(k, "again " * 9, None, 1) for k in (4, 7)] * 100 + [(5, "long " * 4000, None, 1)]
    docs = spark.createDataFrame(many, SCHEMA).repartition(3)
    labels = docs.select("doc_id", "label").distinct()
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    whole = {r[1] for r in many}
    for k, (most, budget) in enumerate([(20, 10 ** 9), (10 ** 6, 5000), (10 ** 6, 10 ** 9)]):
        got = bounded_sample(docs, labels, most, size, budget, Workspace(spark, f"test-sample-{k}")).collect()
        assert len(got) <= most and sum(len(r["text"]) for r in got) <= budget
        assert all(r["text"] in whole for r in got) and {r["label"] for r in got} == {0, 1}
    assert len(got) == len(many)
    assert not any(len(r["text"]) > 10_000 for r in bounded_sample(docs, labels, 10 ** 6, size, 60_000, space).collect())
