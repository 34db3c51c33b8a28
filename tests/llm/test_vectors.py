"""Links and groups of vectors against all pairs."""

import math
import random

import numpy as np
import pytest

from letterflow.llm import cross_polytope as cp

SCHEMA = "vec_id long, embedding array<float>, label int, id long, bucket string, weight int"


def brute(rows, least=cp.LEAST):
    """(vec_id, n_links, component_id, kept) of each row, in order."""
    units = []
    for _, v in rows:
        good = v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if good:
            x = np.array(v, np.float32).astype(float)
            x = x / np.abs(x).max()
            units.append(x / np.sqrt((x * x).sum()))
        else:
            units.append(None)
    near = [[j for j, y in enumerate(units) if j != i and x is not None and y is not None and len(x) == len(y)
             and float(x @ y) >= least] for i, x in enumerate(units)]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            low = min([group[i], *[group[j] for j in others]])
            changed |= low != group[i]
            group[i] = low
    out = []
    for i, (vec, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        name = min(ids, default=None)
        out.append((vec, len(near[i]), name, vec == name if vec is not None and name is not None else name is None))
    return sorted(out, key=repr)


def found(spark, rows, schema=SCHEMA, parts=4, **options):
    extra = () if schema != SCHEMA else (1, 2, "x", 3)
    df = spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(parts)
    return sorted(map(tuple, cp.near_vectors(df, **options).collect()), key=repr)


def around(rng, center, cosine):
    """A vector at this cosine with another."""
    x = np.array(center) / np.linalg.norm(center)
    y = rng.normal(size=len(x))
    y -= (y @ x) * x
    return (cosine * x + math.sqrt(1 - cosine * cosine) * y / np.linalg.norm(y)).tolist()


def corpus(dims=32):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=dims).tolist() for _ in range(120)]
    for center in vectors[:6]:
        vectors += [around(rng, center, c) for c in (0.89, 0.905, 0.93, 0.99)]
    vectors += [around(rng, vectors[0], 0.98) for _ in range(90)] + [vectors[1]] * 40
    chain = vectors[2]
    for _ in range(6):
        chain = around(rng, chain, 0.92)
        vectors.append(chain)
    order = list(range(len(vectors)))
    random.Random(1).shuffle(order)
    return [(k * 3, vectors[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("block, load, told", [(2048, 256, 1 << 16), (16, 4, 1 << 16), (16, 64, -1)])
def test_equals_all_pairs(spark, monkeypatch, block, load, told):
    monkeypatch.setattr(cp, "BLOCK", block)
    monkeypatch.setattr(cp, "STRIPE", 7)
    monkeypatch.setattr(cp, "LOAD", load)
    monkeypatch.setattr(cp, "TOLD", told)
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, None),
            (8, [1.0, 0.0]), (9, [2.0, -0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-30, 0.0]), (12, [3e38, 1e38])]
    assert found(spark, rows) == brute(rows)


def test_null_and_repeated_ids(spark):
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(5, a), (5, a), (5, b), (3, b), (None, a), (None, c), (None, c), (9, c), (None, [0.0, 0.0, 0.0, 1.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_doubles_and_single_numbers(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [-1e200, 1e200]), (4, [5.0]), (5, [2.0]), (6, [-2.0])]
    got = found(spark, rows, schema)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
                          (6, 0, 6, True)], key=repr)


@pytest.mark.parametrize("vectors", [10 ** 3, 10 ** 6, 10 ** 9])
def test_recall_at_the_threshold_follows_from_the_plan(vectors):
    """Pairs at exactly the least cosine, hashed by all tables of the plan."""
    tables = cp.plan(vectors, 64)
    rng = np.random.default_rng(8)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.array([around(rng, x, cp.LEAST) for x in a])
    shared = (tables.buckets(a)[:, :, None] == tables.buckets(b)[:, None, :]).any(axis=(1, 2))
    assert shared.mean() >= 0.998


def test_rotation_keeps_lengths_and_spreads_axes():
    x = np.eye(64)
    y = cp.rotated(x, 5)
    assert np.allclose(y @ y.T, np.eye(64)) and np.abs(y).max() < 0.75


def test_no_pairs_are_written(spark, monkeypatch):
    """A group of n near copies gives a number of rows that grows with n, not with its square."""
    rng = np.random.default_rng(4)
    center = rng.normal(size=16)
    kept = {}
    keep = cp.Workspace.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        kept[name] = out
        return out

    monkeypatch.setattr(cp.Workspace, "keep", counted)
    rows = [(k, around(rng, center, 0.99)) for k in range(300)]
    got = found(spark, rows)
    assert all(r[1] == 299 and r[2] == 0 for r in got)
    assert kept["found"].count() < 300 * 20
