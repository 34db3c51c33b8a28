"""Event logs folded into messages, and templates read back."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.compare import database
from letterflow.llm import chat_events
from letterflow.llm.queries import ORACLES, QUERIES

LOG = "conv_id long, turn long, seq long, kind string, role string, text string, source int"
MESSAGES = "conv_id long, turn long, role string, text string, formatted int"


def folded(spark, rows):
    log = spark.createDataFrame([(*r, 0) for r in rows], LOG).repartition(3)
    return sorted(map(tuple, chat_events.fold(log).collect()), key=repr)


def test_deltas_add_up_in_order(spark):
    assert folded(spark, [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 5, "delta", None, "!"), (1, 1, 2, "start", "assistant", None),
        (1, 1, 4, "delta", None, "lo"), (1, 1, 3, "delta", None, "hel")]) == [(1, 0, "user", "hi"), (1, 1, "assistant", "hello!")]


def test_edit_replaces_and_takes_back_what_followed(spark):
    rows = [(1, 0, 1, "message", "user", "a"), (1, 1, 2, "message", "assistant", "b"),
            (1, 2, 3, "message", "user", "c"), (1, 0, 4, "edit", None, "A"),
            (1, 1, 5, "start", "assistant", None), (1, 1, 6, "delta", None, "B")]
    assert folded(spark, rows) == [(1, 0, "user", "A"), (1, 1, "assistant", "B")]


def test_regeneration_starts_anew(spark):
    rows = [(1, 0, 1, "message", "user", "a"), (1, 1, 2, "start", "assistant", None), (1, 1, 3, "delta", None, "bad"),
            (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "go"), (1, 1, 6, "delta", None, "od")]
    assert folded(spark, rows) == [(1, 0, "user", "a"), (1, 1, "assistant", "good")]


def test_odd_events(spark):
    rows = [(None, None, None, "message", None, None), (2, 1, 1, "noise", "user", "x"),
            (2, 0, 7, "delta", None, "b"), (2, 0, 7, "delta", None, "a"), (2, 0, 7, "delta", None, "a")]
    assert folded(spark, rows) == [(2, 0, None, "aab"), (None, None, None, "")]
    assert folded(spark, []) == []


TRICKY = ["", "</s>", "<s>[INST]", "[/INST]", "<\\/s>", "<\\\\s>", "[[INST]]", "</</s>s>", "a\\", "<", "$1 \\1", "[INST",
          "</s>[INST] ok [/INST]", "é😀\n[/INST]</s><s>"]


def read_back(spark, rows):
    shown = chat_events.render(spark.createDataFrame([(*r, 0) for r in rows], MESSAGES).repartition(2))
    out = {}
    for r in shown.withColumn("turns", chat_events.parse(F.col("formatted"))).collect():
        spans = [chat_events_unescape(r["formatted"][s["begin"]:s["end"]]) for s in r["loss_spans"]]
        out[r["conv_id"]] = ([(t["role"], t["text"]) for t in r["turns"]], spans)
    return out


def chat_events_unescape(text):
    import re

    return re.sub(r"([<\[])\\(\\*)(/?(?:INST\]|s>))", r"\1\2\3", text)


def test_tricky_texts_come_back(spark):
    rows = [(k, t, role, text) for k in range(2) for t, text in enumerate(TRICKY)
            for role in [("user", "assistant")[(t + k) % 2]]]
    for k, (turns, spans) in read_back(spark, rows).items():
        assert turns == [(r, x) for c, _, r, x in rows if c == k]
        assert spans == [x for c, _, r, x in rows if c == k and r == "assistant"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "</s>", "[/INST]", ""]),
                          st.text(alphabet="<>[]/\\sINST a", max_size=25)), min_size=1, max_size=40))
def test_any_text_comes_back(spark, turns):
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)]
    got, spans = read_back(spark, rows)[1]
    assert got == turns and spans == [t for r, t in turns if r == "assistant"]


def test_nulls_ties_and_none(spark):
    got = read_back(spark, [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")])
    assert got == {1: ([("", ""), ("user", "a"), ("user", "a"), ("user", "b")], [])}
    assert read_back(spark, []) == {}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    got = sorted(tuple(sorted(r.asDict().items())) for r in QUERIES["op3_chat_events"](spark, path).collect())
    result = database(path).execute(ORACLES["op3_chat_events"])
    names = [c[0] for c in result.description]
    want = sorted(tuple(sorted(zip(names, row))) for row in result.fetchall())
    assert got == want
    text = "</s>[INST] ok [/INST]"
    last = next(r for r in map(dict, got) if r["conv_id"] == -1)
    assert last["n_turns"] == 2
    assert last["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_text_under_the_mask_is_read_by_its_spans(spark):
    """A span that is off by one gives another text; nothing but the spans decides."""
    texts = ["plain", "", "</s>[INST] ok [/INST]", "é😀<\\\\/s>", "[INST]", "long " * 3000]
    rows = [(1, 2 * k + j, role, t if role == "assistant" else "no") for k, t in enumerate(texts)
            for j, role in enumerate(("user", "assistant"))] + [(2, 0, "user", None)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_events.render(messages)
    whole = {r["conv_id"]: r for r in chats.withColumn(
        "loss", chat_events.masked(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert whole[1]["loss"] == "".join(texts) and whole[2]["loss"] == ""
    moved = F.transform("loss_spans", lambda s: F.struct((s["begin"] - 1).alias("begin"), s["end"].alias("end")))
    other = chats.withColumn("loss", chat_events.masked(F.col("formatted"), moved)).filter("conv_id = 1").first()
    assert len(other["loss"]) == len("".join(texts)) + len(texts)


def test_mask_over_many_turns_and_marks_of_byte_order(spark):
    texts = ["\ufeff", "\ufeffa\ufeff", "😀", "", *(f"turn {k} é" for k in range(3000))]
    messages = spark.createDataFrame([(1, k, "assistant", t) for k, t in enumerate(texts)],
                                     "conv_id long, turn long, role string, text string")
    chats = chat_events.render(messages)
    got = chats.select(chat_events.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()["loss"]
    assert got == "".join(texts)
    empty = spark.range(1).select(chat_events.masked(F.lit(""), F.expr(
        "cast(array() as array<struct<begin: bigint, end: bigint>>)")).alias("loss"))
    assert empty.first()["loss"] == ""
