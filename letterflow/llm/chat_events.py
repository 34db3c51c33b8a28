"""Chat texts from event logs: fold deltas, edits and regenerations into messages, then render them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template: each turn is BEGIN role HEAD text END.
BEGIN, HEAD, END = "<s>[INST]", "[/INST]", "</s>"
#: What a control string looks like after its first character, with any number of escapes before it.
_TAIL = r"(/?(?:INST\]|s>))"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    r"""Control strings made harmless: one more \ after the first character of each."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """What `escape` was given."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """Final messages of a log, one row for each conversation and turn that is left.

    events: conv_id, turn, seq, kind, role, text; other columns are ignored. Kinds, in order of seq:

    * `message` sets the turn's text, `start` begins it empty, `delta` adds to it,
    * `edit` replaces the turn's text, `regenerate` empties it for new deltas; both take back
      all events of later turns that came before them, as the conversation goes on from there.

    Events with equal seq are taken in order of turn, kind and text. A null text is empty. The role is that
    of the turn's last event that has one, or empty. Other kinds are ignored. Null conv_id, turn and
    seq are values of their own, before all others; an empty log has no messages.
    """
    log = events.select(
        "conv_id", "turn", "seq", "kind", F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).filter(F.col("kind").isin("message", "start", "delta", "edit", "regenerate"))
    # a place after every event with a smaller seq, null first
    log = log.withColumn("at", F.struct(F.col("seq").isNotNull(), "seq"))
    turns = log.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("kind") != "delta", F.col("at"))).alias("reset"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("at"))).alias("cut"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("at", "kind", "role"))).alias("named"))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), "reset",
        F.max("cut").over(earlier).alias("taken_back"), F.col("named.role").alias("final_role"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
    live = log.join(turns, same).filter(
        (F.col("taken_back").isNull() | (F.col("at") > F.col("taken_back")))
        & (F.col("reset").isNull() | (F.col("at") >= F.col("reset")))
        & (F.col("kind") != "regenerate"))
    rank = F.when(F.col("kind") == "delta", 1).otherwise(0)
    return live.groupBy("conv_id", "turn").agg(
        F.first("final_role").alias("role"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("at", rank.alias("rank"), "kind", "text"))),
            lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans.

    messages: conv_id, turn, role, text. Turns stand in order, null first, equal ones by role and text.
    loss_spans: for each assistant's escaped text its turn (from 0), begin and end (code points of
    `formatted`, end left out). A conversation is one row of the result, so its text must fit into one task.
    """
    part = messages.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sized = part.select(
        "conv_id", "turn", "role", "text", F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(HEAD)).alias("lead"),
        escape(F.col("text")).alias("body")).withColumn(
        "size", F.length("lead").cast("long") + F.length("body") + len(END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = sized.withColumn("index", F.row_number().over(order) - 1).withColumn(
        "begin", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
        - F.length("body") - len(END))
    pieces = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "index", F.concat("lead", "body", F.lit(END)).alias("piece"),
        (F.col("role") == LOSS_ROLE).alias("loss"), "begin",
        (F.col("begin") + F.length("body")).alias("end")))).alias("m"))
    return pieces.select(
        "conv_id", F.array_join(F.col("m.piece"), "").alias("formatted"),
        F.transform(F.filter("m", lambda x: x["loss"]), lambda x: F.struct(
            x["index"].alias("turn"), x["begin"].alias("begin"), x["end"].alias("end"))).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Turns read back from a formatted conversation: array of (role, text)."""
    pieces = F.filter(F.split(formatted, END), lambda x: x != "")
    lead = lambda x: F.instr(x, HEAD) - 1
    return F.transform(pieces, lambda x: F.struct(
        unescape(F.substring(x, F.lit(len(BEGIN) + 1), lead(x) - len(BEGIN))).alias("role"),
        unescape(F.substring(x, lead(x) + len(HEAD) + 1, F.length(x))).alias("text")))


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped: what stands between each span's begin and end, in order.

    Null or empty texts and no spans give an empty text. The text is encoded once, four bytes a code point, so
    a span is cut out at its place and the cost grows with the text, not with the number of spans times it.
    """
    wide = F.array(F.encode(formatted, "UTF-32"))
    # a character before each span, as a decoder takes a leading U+FEFF for a mark of byte order
    cut = lambda w, s: F.concat(F.lit(b"\0\0\0x"), F.substring(
        w, (s["begin"] * 4 + 1).cast("int"), ((s["end"] - s["begin"]) * 4).cast("int")))
    text = lambda w, s: F.substring(F.decode(cut(w, s), "UTF-32"), F.lit(2), F.length(w))
    # the outer array has one element, a name for the encoded text that is not evaluated anew in each span
    return F.array_join(F.flatten(F.transform(wide, lambda w: F.transform(spans, lambda s: unescape(text(w, s))))), "")
