"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterflow.llm.tables import Workspace, running_total, unused, widened
from letterflow.llm.textcols import _IS_SPACE, blocks, utf8

#: Weights of the sources in order of code points (null last), over and over.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and how often a source's words may be used.
BUDGET, MOST = 1.5, 2
#: Words of a block, and blocks that a small source has at least, as far as it has words.
BLOCK_WORDS, LEAST_BLOCKS = 128, 64
#: The golden ratio's fraction in units of 2 ** -32: slot k stands at k * GOLDEN modulo 2 ** 32.
GOLDEN, CIRCLE = 2654435769, 1 << 32
#: Slots that a mix has, about, at most: beyond, blocks grow with the corpus.
SLOTS = 1 << 31
#: The circle in cells, for finding the source of a point by equality.
CELLS = 1 << 16
#: Rows summed in order by one task: a source is dealt into as many parts as its rows make.
PART_ROWS = 1 << 11


def _counted(batches):
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        counts = [np.zeros(0, np.int64)]
        for a, b in blocks(at):
            own, begin = raw[at[a]:at[b]], at[a:b + 1] - at[a]
            inside = ~_IS_SPACE[own]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            starts = begin[:-1][begin[:-1] < len(own)]
            first[starts] = inside[starts]
            total = np.concatenate([[0], np.cumsum(first)])
            counts.append(np.diff(total[begin]))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], pa.array(np.concatenate(counts), pa.int64())],
            names=[*names, "size"])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, sid (its place), source_size, target: words of each source in the mix.

    sizes: source, source_size. The budget goes by weight; what a source cannot take (more than MOST
    times its words) goes to the others by weight, until none is above: each target is the smaller
    of that bound and level * weight. The level follows from sums over the sources in order of
    bound / weight. One row for each source is held in one task.
    """
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    known = sizes.withColumn("sid", place).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1)
    ).withColumn("bound", F.col("source_size") * float(MOST)).withColumn(
        "budget", F.sum("source_size").over(every) * F.lit(BUDGET))
    order = Window.orderBy(F.col("bound") / F.col("weight"), "sid")
    level = (F.col("budget") - F.coalesce(F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
             ) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = known.withColumn("level", level)
    full = F.col("bound") / F.col("weight") <= F.col("level")
    final = F.min_by("level", F.when(~full, F.struct(F.col("bound") / F.col("weight"), "sid"))).over(every)
    return ranked.withColumn("final", final).select(
        "source", "sid", "source_size",
        F.when(F.col("final").isNull(), F.col("bound")).otherwise(
            F.least("bound", F.col("final") * F.col("weight"))).alias("target"))


def schedule(plan: DataFrame, slots: int, settled: bool = False) -> DataFrame:
    """sid, block, uses: how often the slots of the schedule take each block of a source.

    plan: sid, share (slots wanted), blocks. Slot k stands at the fraction of k times the golden ratio;
    the sources' cumulative shares part the circle, so every run of slots holds each source in
    proportion. The r-th slot of a source takes its block r modulo blocks. Slots beyond MOST rounds
    of a source's blocks, of which rounding can leave one or two, stay empty. If settled, each source has
    as many slots as its share rounded (MOST rounds at most): the last ones go, or some follow.
    """
    spark = plan.sparkSession
    order = Window.orderBy("sid")
    every = F.sum("share").over(Window.partitionBy())
    edge = lambda total: F.floor(total / every * F.lit(float(CIRCLE))).cast("long")
    upto = F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0))
    most = F.col("blocks") * MOST
    if settled:
        most = F.least(F.round("share").cast("long"), most)
    plan = plan.withColumn("most", most)
    arcs = plan.filter("share > 0").select("sid", "blocks", "most", edge(upto).alias("end")).withColumn(
        "begin", F.coalesce(F.lag("end").over(order), F.lit(0).cast("long"))).filter("begin < end")
    cells = arcs.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("begin") / (CIRCLE // CELLS)), F.floor((F.col("end") - 1) / (CIRCLE // CELLS)))))
    # id * GOLDEN modulo CIRCLE in halves, so that any number of slots fits a long
    half = lambda shift: F.shiftright("id", shift).bitwiseAND(0xFFFF) * F.lit(GOLDEN) % F.lit(CIRCLE)
    points = spark.range(slots).select("id", ((half(0) + half(16) * 65536) % F.lit(CIRCLE)).alias("point"))
    taken = points.withColumn("cell", F.floor(F.col("point") / (CIRCLE // CELLS))).join(cells, "cell").filter(
        "point >= begin and point < end").select(
        "sid", "blocks", "most", "id", F.floor(F.col("id") / PART_ROWS).alias("part"), F.lit(1).cast("long").alias("one"))
    ranked = running_total(taken, "one", ["sid"], "part", [F.col("id")], "rank")
    ranked = ranked.filter("rank < most").select("sid", "blocks", "rank")
    if settled:
        got = ranked.groupBy(F.col("sid").alias("_sid")).agg((F.max("rank") + 1).alias("got"))
        short = plan.join(got, F.col("sid") == F.col("_sid"), "left").withColumn("got", F.coalesce("got", F.lit(0)))
        ranked = ranked.unionAll(short.filter("got < most").select(
            "sid", "blocks", F.explode(F.sequence(F.col("got"), F.col("most") - 1)).alias("rank")))
    return ranked.groupBy(
        "sid", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("uses"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, space: Workspace | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, taken of every document, and its row's number.

    docs: doc_id, text, source. Words are `[^\\x20\\x09-\\x0D]+`. A source's documents, shuffled by the
    hash of doc_id, make one stream of words, cut into blocks of `block_words` (the last one longer), or
    of a LEAST_BLOCKS-th of a smaller source, one word at least; `taken` is what the schedule's slots
    take of a document's words, repeats counted: at most MOST times each. A source's taken words
    differ from its target by less than two of its blocks. Of a corpus with more than SLOTS blocks in the
    mix, blocks are as many words longer, so a schedule has about SLOTS slots whatever its size.

    Null texts and texts without words have size 0 and taken 0. A null source is one of its own. Rows
    without doc_id are shuffled by their place in the table; repeated rows are rows of their own. An
    empty table has no rows. Other columns are ignored.
    """
    space = space or Workspace(docs.sparkSession, "mixing")
    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.monotonically_increasing_id().alias("_rid"),
        F.col("text").cast("string").alias("text"))
    rows = space.keep(rows.mapInArrow(_counted, widened(rows.drop("text"), size="long")), "sizes")
    sources = rows.groupBy(F.col("source").alias("name")).agg(
        F.sum("size").alias("source_size"), F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    words = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    block_words = max(block_words, -(-round(words * BUDGET) // SLOTS))
    plan = space.keep(targets(sources.select(F.col("name").alias("source"), "source_size")).join(
        sources.select("name", "parts"), F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn(
        "block_words", F.greatest(F.least(F.floor(F.col("source_size") / LEAST_BLOCKS), F.lit(block_words)), F.lit(1))
        .cast("long")).withColumn(
        "blocks", F.greatest(F.floor(F.col("source_size") / F.col("block_words")), F.lit(1)).cast("long")).withColumn(
        "share", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size"))
        .otherwise(F.lit(0.0))), "plan")
    total = plan.agg(F.sum("share").alias("slots")).first()["slots"]
    slots = round(total or 0)
    known = rows.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop(
        "_source", "share")
    known = known.withColumn("_hash", F.xxhash64(F.coalesce(F.col("doc_id"), F.col("_rid")))).withColumn(
        "_part", F.pmod("_hash", "parts")).drop("parts")
    known = space.keep(running_total(
        known, "size", ["sid"], "_part", [F.col("_hash"), F.col("doc_id"), F.col("_rid")], "begin"), "streams")
    uses = schedule(plan.select("sid", "share", "blocks"), slots, settled=True)
    end = F.col("begin") + F.col("size")
    block = lambda word: F.least(F.floor(word / F.col("block_words")), F.col("blocks") - 1)
    pieces = known.filter("size > 0").select(
        "_rid", "sid", "blocks", "block_words", "begin", end.alias("end"), "source_size",
        F.explode(F.sequence(block(F.col("begin")), block(end - 1))).alias("block"))
    held = F.least("end", F.when(F.col("block") == F.col("blocks") - 1, F.col("source_size")).otherwise(
        (F.col("block") + 1) * F.col("block_words"))) - F.greatest("begin", F.col("block") * F.col("block_words"))
    taken = pieces.select("_rid", "sid", "block", held.alias("words")).join(uses, ["sid", "block"]).groupBy(
        F.col("_rid").alias("_row")).agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    return known.join(taken, F.col("_rid") == F.col("_row"), "left").select(
        "doc_id", "size", "source", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("_rid").alias("row"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns: each as often as its taken words go into its words.

    The share is rounded, so a document is there up to MOST times or not at all; one without words, its text
    null or empty, stays. Rows are told apart by their place, whatever their doc_id; repeated rows are
    rows of their own. No column is lost or replaced. An empty table gives no rows.
    """
    space = Workspace(docs.sparkSession, "mixed")
    row, own, times, turn = unused(docs, "mix_row", "mix_id", "mix_n", "mix_k")
    rows = space.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    part = mix(rows.select(F.col(row).alias("doc_id"), "text", "source"), space=space).select(
        F.col("doc_id").alias(own),
        F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int").alias(times))
    return rows.join(part, F.col(row) == F.col(own)).filter(F.col(times) > 0).withColumn(
        turn, F.explode(F.sequence(F.lit(1), times))).drop(row, own, times, turn)
