"""Laws of k-d tree shards."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from letterflow.llm import kd_shards

SCHEMA = "doc_id long, text string, lang string, source string, size string, shard string"


def corpus(n, rng):
    return [(k if rng.random() < 0.95 else None, rng.choice([None, "", "x" * rng.randrange(1, 400), "same text"]),
             rng.choice(["en", "de", None]), rng.choice(["hot"] * 5 + [f"s{k % 9}", None]), "c", "c") for k in range(n)]


def check(rows, shards, slack):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards))
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    held = [sum(r["size"] for r in by[s]) for s in range(shards)]
    assert max(held) - min(held) <= slack, held


@pytest.mark.parametrize("shards", [1, 2, 7, 24])
def test_shards_are_near_equal(spark, shards):
    rows = corpus(900, random.Random(shards))
    out = kd_shards.document_shards(spark.createDataFrame(rows, SCHEMA).repartition(4), shards=shards)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "source", "size", "shard", "slot"]
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(r[0]), str(r[1])) for r in rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 for r in got)
    check(got, shards, 5 * 408)


def test_equal_rows_are_split_evenly(spark):
    docs = spark.createDataFrame([(1, "copy", "en", "a", None, None)] * 400, SCHEMA).repartition(5)
    check(kd_shards.document_shards(docs, shards=8).collect(), 8, 12 * 4)


def test_splits_the_widest_dimension_first(spark):
    docs = spark.range(64).select("id", F.lit(1).alias("weight"), (F.col("id") % 8).alias("x"),
                                  F.floor(F.col("id") / 8).alias("y"))
    out = kd_shards.kd_shards(docs, F.lit(1), [F.col("x"), F.col("y")], shards=4).collect()
    boxes = defaultdict(set)
    for r in out:
        boxes[r["shard"]].add((r["x"] // 4, r["y"] // 4))
    assert all(len(b) == 1 for b in boxes.values()) and len(boxes) == 4


def test_target_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * 92, "en", "a", None, None) for k in range(50)], SCHEMA)
    out = kd_shards.document_shards(docs, target_bytes=1000).collect()
    assert {r["shard"] for r in out} == set(range(5))
    check(out, 5, 200)


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(None, None, None, None, None, None)], SCHEMA)
    got = kd_shards.document_shards(one, shards=24).collect()
    assert len(got) == 1 and got[0]["slot"] == 0 and 0 <= got[0]["shard"] < 24
    none = kd_shards.document_shards(spark.createDataFrame([], SCHEMA), shards=24)
    assert none.collect() == [] and none.columns[-2:] == ["shard", "slot"]


def test_reruns_agree(spark):
    docs = spark.createDataFrame(corpus(300, random.Random(1)), SCHEMA).repartition(3, "text")
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"])
    assert sorted(map(key, kd_shards.document_shards(docs, 6).collect())) == sorted(
        map(key, kd_shards.document_shards(docs, 6).collect()))


def test_columns_like_helpers_stay(spark):
    names = ["doc_id", "text", "lang", "source", "_date", "_Domain", "__d0", "_rid", "_place"]
    rows = [(k, "x" * (k % 50), "en", "s", f"d{k}", "m", k, -k, "p") for k in range(200)]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, (
        "long", "string", "string", "string", "string", "string", "long", "long", "string"))))
    out = kd_shards.document_shards(docs, shards=4)
    assert out.columns == [*names, "size", "shard", "slot"] or out.columns == [*names, "shard", "slot"]
    assert sorted(tuple(r[n] for n in names) for r in out.collect()) == sorted(rows)
    none = kd_shards.document_shards(docs.limit(0), shards=4)
    assert none.columns == out.columns and none.collect() == []


def brute(rows, shards, dims):
    """Shard of each row (weight, *places): the same splits, one box after another."""
    out, boxes = {}, [(0, shards, list(range(len(rows))))]
    while boxes:
        first, leaves, own = boxes.pop()
        if leaves == 1:
            out.update((k, first) for k in own)
            continue
        spread = [max(rows[k][1 + d] for k in own) - min(rows[k][1 + d] for k in own) for d in range(dims)]
        dim = spread.index(max(spread))
        own.sort(key=lambda k: rows[k][1 + dim])
        target, below, cut = sum(rows[k][0] for k in own) * (leaves // 2) / leaves, 0, 0
        for cut, k in enumerate(own):
            after = below + rows[k][0]
            if after >= target:
                cut += not target - below < after - target
                break
            below = after
        boxes += [(first, leaves // 2, own[:cut]), (first + leaves // 2, leaves - leaves // 2, own[cut:])]
    return out


@pytest.mark.parametrize("shards", [2, 5, 24])
def test_equals_a_tree_built_box_by_box(spark, monkeypatch, shards):
    monkeypatch.setattr(kd_shards, "TOLERANCE", 0)
    monkeypatch.setattr(kd_shards, "BINS", 16)
    rng, n = random.Random(shards), 400
    rows = list(zip([rng.randrange(1, 90) for _ in range(n)], rng.sample(range(n), n), rng.sample(range(n), n)))
    # the grid keeps the order of places, but not quite their distances
    grid = [(w, *[x * (kd_shards.GRID - 1) // (n - 1) for x in places]) for w, *places in rows]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, weight long, x long, y long").repartition(3)
    got = kd_shards.kd_shards(docs, F.col("weight"), [F.col("x"), F.col("y")], shards=shards).collect()
    assert {r["k"]: r["shard"] for r in got} == brute(grid, shards, 2)


def test_copies_lie_side_by_side(spark):
    """A group of copies is cut at edges of shards only: never more groups in two shards than there are edges."""
    rng = random.Random(8)
    rows = [(k, f"text {rng.randrange(60):04}", "en", "s", None, None) for k in range(900)]
    out = kd_shards.document_shards(spark.createDataFrame(rows, SCHEMA).repartition(4), shards=12).collect()
    shards_of = defaultdict(set)
    for r in out:
        shards_of[r["text"]].add(r["shard"])
    assert sum(len(s) - 1 for s in shards_of.values()) <= 11
    check(out, 12, 12 * 18)


def test_very_long_text(spark):
    rows = [(k, "x" * 50, "en", "s", None, None) for k in range(60)] + [(99, "y" * 3_000_000, "de", "t", None, None)]
    out = kd_shards.document_shards(spark.createDataFrame(rows, SCHEMA), shards=4).collect()
    check(out, 4, 3_000_100)
    assert len(out) == 61 and len({r["shard"] for r in out}) >= 2


def test_no_python_workers(spark):
    plan = kd_shards.document_shards(spark.createDataFrame(corpus(50, random.Random(2)), SCHEMA), shards=3)
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    table = kd_shards._table(plan, [(1, 2.5)], "node int, want double")
    assert table.collect() == [(1, 2.5)] and "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()
