"""The log and its proofs against a tree built level by level."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from letterflow.llm import merkle, tables
from letterflow.llm.queries import ORACLES, QUERIES
from letterflow.llm.tables import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, pos long, _part long"


def digest(text):
    return sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][k:k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def way(tree, k):
    """(sibling before, sibling after) of a leaf at every level."""
    out = []
    for row in tree[:-1]:
        out.append((row[k - 1] if k % 2 else None, row[k + 1] if k % 2 == 0 and k + 1 < len(row) else None))
        k //= 2
    return out


def brute(rows, changed):
    """Sorted rows of `audited`; changed gives a row's claimed n_chars."""
    langs = {}
    for doc, text, lang, source, n in rows:
        leaf = digest("".join(map(field, (doc, source, lang, n, text))))
        claim = digest("".join(map(field, (doc, source, lang, changed(doc, n), text))))
        langs.setdefault(lang, []).append((doc is not None, doc or 0, leaf, claim, doc))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels([x[2] for x in sorted(langs[lang])]) for lang in order}
    top = levels([trees[lang][-1][0] for lang in order])
    out = []
    for place, lang in enumerate(order):
        for k, (_, _, leaf, claim, doc) in enumerate(sorted(langs[lang])):
            steps = way(trees[lang], k) + way(top, place)
            now = claim
            for before, after in steps:
                now = digest((before or "") + now + (after or ""))
            proof = digest("".join((b or a) for b, a in steps if b or a))
            out.append((doc, leaf, trees[lang][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=repr)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(parts)


def corpus(sizes):
    rng = random.Random(5)
    rows = [(rng.randrange(10 ** 6), f"text {k} é", lang, rng.choice(["a", None, "ü"]), rng.choice([None, k]))
            for lang, n in sizes.items() for k in range(n)]
    rng.shuffle(rows)
    return rows


def claims():
    return F.when(F.col("doc_id") % 3 == 0, merkle.digest_of(
        [F.col(c) if c != "n_chars" else F.col(c) + 1 for c in ("doc_id", "source", "lang", "n_chars", "text")]))


def claimed(doc, n):
    return n + 1 if n is not None and doc is not None and doc % 3 == 0 else n


@pytest.mark.parametrize("span, sizes", [
    (1, {"a": 1, "b": 2, "c": 3, None: 5, "é": 8}), (2, {"a": 37, "b": 16, "c": 17, "Z": 1}),
    (3, {"a": 64, None: 65, "b": 63}), (10, {"one": 300})])
def test_equals_a_tree_built_level_by_level(spark, monkeypatch, span, sizes):
    monkeypatch.setattr(tables, "RANGE_ROWS", 20)
    rows = corpus(sizes)
    got = merkle.audited(table(spark, rows), claims(), span=span)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, claimed)


def test_nulls_ties_repeated_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(tables, "RANGE_ROWS", 4)
    rows = ([(7, "same", "a", "s", 4)] * 9 + [(7, "other", "a", "s", 5), (None, "x", "a", None, None), (None, "y", None, None, 1)]
            + [(None, None, None, None, None)] * 3 + [(9, "", "", "", 0), (8, "long " * 400_000, "a", "s", 1)])
    got = merkle.audited(table(spark, rows), claims(), span=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, claimed)


def test_empty_table_and_lone_row(spark):
    assert merkle.audited(table(spark, [])).collect() == []
    row = merkle.audited(table(spark, [(1, "t", "l", "s", 1)])).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"]
    assert row["proof_sha256"] == digest("")


def test_log_is_in_postorder_without_gaps(spark):
    space = Workspace(spark, "test-merkle")
    for n in (1, 7, 33):
        leaves = spark.createDataFrame([("t", n, k, bytes([k]) * 32) for k in range(n)], "tree string, n long, at long, digest binary")
        log = sorted(merkle.build(space, leaves, f"log-{n}", span=2).log.collect(), key=lambda r: r["pos"])
        assert [r["pos"] for r in log] == list(range(merkle.subtree_size(merkle.tree_height(n), n)))
        stack = []  # a log in completion order can be folded with a stack
        for r in log:
            if r["height"] == 0:
                stack.append((0, r["at"], bytes(r["digest"])))
            else:
                own = [x for x in stack if x[0] == r["height"] - 1 and x[1] >> 1 == r["at"]]
                del stack[len(stack) - len(own):]
                assert merkle.parent(*(x[2] for x in own)) == bytes(r["digest"])
                stack.append((r["height"], r["at"], bytes(r["digest"])))
        assert len(stack) == 1


def test_tampering_with_any_row_is_seen(spark):
    rows = corpus({"a": 30, "b": 11})
    everywhere = merkle.digest_of([F.lit("x"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")])
    got = merkle.audited(table(spark, rows), everywhere, span=3).collect()
    assert len(got) == 41 and not any(r["verified"] for r in got)


def test_query_equals_its_sql(spark):
    from checks.compare import database, difference

    path = "/root/testdata/sf0.001"
    assert difference(spark, database(path), QUERIES["op12_merkle_log"], ORACLES["op12_merkle_log"], path)[0] is None
