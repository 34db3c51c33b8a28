"""Targets, schedule and taken words against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from letterflow.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, taken string, blocks int"


def poured(sizes):
    """Targets by pouring the excess again and again, in plain numbers."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, open_ = 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 5, "d": 0, None: 7}, {None: 40},
    {"Z": 5, "a": 900, "é": 30, "😀": 10, "b": 10}, {"a": 0, "b": 0}, {"x" * k: k * k for k in range(1, 12)}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    want = poured(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_schedule_equals_a_plain_walk(spark):
    shares, blocks = [13.0, 0.0, 40.5, 6.5], [9, 1, 30, 2]
    plan = spark.createDataFrame([(k, s, b) for k, (s, b) in enumerate(zip(shares, blocks))], "sid int, share double, blocks long")
    got = {(r["sid"], r["block"]): r["uses"] for r in mixing.schedule(plan, 60).collect()}
    edges = [int(sum(shares[:k + 1]) / sum(shares) * mixing.CIRCLE) for k in range(4)]
    want, rank = {}, [0] * 4
    for k in range(60):
        point = k * mixing.GOLDEN % mixing.CIRCLE
        s = next(i for i, e in enumerate(edges) if point < e)
        if rank[s] < 2 * blocks[s]:
            want[s, rank[s] % blocks[s]] = want.get((s, rank[s] % blocks[s]), 0) + 1
        rank[s] += 1
    assert got == want


def test_every_run_of_slots_is_in_proportion():
    counts = [0, 0]
    for k in range(5000):
        counts[k * mixing.GOLDEN % mixing.CIRCLE >= 0.3 * mixing.CIRCLE] += 1
        assert abs(counts[0] - 0.3 * (k + 1)) < 4


def corpus():
    rng = random.Random(6)
    rows = []
    for k in range(600):
        source = rng.choice(["hot"] * 6 + ["a", "b", "ü", None])
        text = rng.choice([None, "", " \n", "w " * rng.randrange(1, 300), "same words here"])
        rows.append((k if k % 40 else None, text, source, "c", "c", 1))
    return rows + [(3, "same words here", "a", None, None, None)] * 3 + [(9999, "long " * 40_000, "b", None, None, None)]


def test_laws_of_the_mix(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4, "text")
    got = mixing.mix(docs, 16).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), words(r[1])) for r in rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    want, taken = poured(sizes), {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 5 * 32 for s in want)
    key = lambda r: (r["doc_id"] or -1, r["row"], r["taken"])
    assert sorted(map(key, mixing.mix(docs, 16).collect())) == sorted(map(key, got))


def test_mixed_rows_keep_their_columns(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(4, "text")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    most = max(r["count"] for r in out.filter("doc_id > 3").groupBy("doc_id").count().collect())
    assert most <= 2
    blank = F.coalesce(F.trim("text"), F.lit("")).isin("", "\n")
    assert out.filter(blank).count() == docs.filter(blank).count()


def test_mixed_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(k, "some words here", "a", 7, 8, 9) for k in range(200)],
                                 "doc_id long, text string, source string, _mix_row int, _MIX_N int, __mix_k int")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {tuple(r)[3:] for r in out.collect()} == {(7, 8, 9)}


@pytest.mark.parametrize("slots", [40, 700])
def test_blocks_grow_with_the_corpus(spark, monkeypatch, slots):
    """More words than slots of the usual blocks: a whole mix near its targets, in longer blocks."""
    monkeypatch.setattr(mixing, "SLOTS", slots)
    rng, rows = random.Random(2), []
    for k in range(3000):
        rows.append((k, "w " * rng.randrange(1, 120), rng.choice("aaaaab"), None, None, None))
    sizes = {s: sum(r[1].count("w") for r in rows if r[2] == s) for s in "ab"}
    words = -(-round(sum(sizes.values()) * 1.5) // slots)
    assert words > 128
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    for source, want in poured(sizes).items():
        taken = sum(r["taken"] for r in got if r["source"] == source)
        assert abs(taken - want) <= 2 * min(words, max(128, sizes[source] // 64))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_slots_beyond_the_circle(spark):
    ids = [0, 1, 65_535, 65_536, (1 << 31) - 1, 1 << 31, (1 << 40) + 12_345]
    half = lambda n, shift: (n >> shift & 0xFFFF) * mixing.GOLDEN % mixing.CIRCLE
    for n in ids:
        assert (half(n, 0) + half(n, 16) * 65536) % mixing.CIRCLE == n * mixing.GOLDEN % mixing.CIRCLE


def test_empty_and_wordless_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, None, None), (2, "", "a", None, None, None)], SCHEMA)
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in mixing.mix(blank).collect()) == [
        (1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_small_sources_get_their_targets(spark):
    sizes = {f"s{k:02}": n for k, n in enumerate((20_000, 1, 2, 3, 7, 30, 64, 100, 150, 200, 255, 300, 700, 5000, 9000))}
    rng, rows = random.Random(12), []
    for source, n in sizes.items():
        while n:
            part = min(n, rng.randrange(1, 40))
            rows.append((len(rows), "w " * part, source, None, None, None))
            n -= part
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    want = poured(sizes)
    assert len(got) == len(sizes)
    for r in got:
        n = sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]]
        assert abs(r["taken"] - r["target"]) <= 2 * min(128, max(1, n // 64)), (n, r)
