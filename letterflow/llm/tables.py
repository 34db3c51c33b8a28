"""Tables kept between jobs, rows numbered and summed in order without one big task."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


_within: ContextVar[str | None] = ContextVar("within", default=None)


class Workspace:
    """A new folder for one run's tables, in the folder all executors share.

    The folder is `spark.checkpoint.dir`; where it is unset, in local mode only, a temporary one.
    Tables stay until `remove` or until the caller deletes `path`, since a result may still read
    them. Operators take a workspace of the caller's, or make one, which then lies below
    `holding` of an outer workspace, if there is one.
    """

    def __init__(self, spark: SparkSession, name: str):
        shared = _within.get() or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="letterflow-")
        self.spark = spark
        self.path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    @contextmanager
    def holding(self, name: str):
        """Workspaces made in this block lie in the folder `name` of this one, to be removed together."""
        before = _within.set(f"{self.path}/{name}")
        try:
            yield
        finally:
            _within.reset(before)

    def remove(self, name: str) -> None:
        """Delete a table, or all workspaces held under a name, once no result reads them any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back: later steps neither repeat its work nor lose it."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names with as many underscores before them as keep them from all columns of df, whatever their case."""
    lead = "_"
    while any(c.lower().startswith(lead) for c in df.columns):
        lead += "_"
    return [lead + name for name in names]


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def before(df: DataFrame, value: str, groups: list[str], part: str, order: list[Column]) -> Column:
    """Sum of `value` over the rows that come earlier in the same group and part."""
    rows = Window.partitionBy(*groups, part).orderBy(*order)
    return F.coalesce(
        F.sum(value).over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running_total(df: DataFrame, value: str, groups: list[str], part: str,
                  order: list[Column], out: str) -> DataFrame:
    """Add the sum of `value` over all earlier rows of the group, parts in ascending order.

    Rows are only ordered within a part; what the parts before hold is summed over one row per
    part. Parts must be small enough for a task and must not follow a key that may be common.
    """
    sizes = df.groupBy(*groups, part).agg(F.sum(value).alias("_held"))
    offsets = sizes.select(
        *[F.col(g).alias(f"_{g}") for g in groups], F.col(part).alias("_at"),
        F.coalesce(F.sum("_held").over(
            Window.partitionBy(*groups).orderBy(part)
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    same = F.col(part) == F.col("_at")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    within = df.withColumn(out, before(df, value, groups, part, order))
    return within.join(offsets, same).withColumn(out, F.col(out) + F.col("_offset")).drop(
        "_at", "_offset", *[f"_{g}" for g in groups])


def bounded_sample(docs: DataFrame, labels: DataFrame, most: int, cost: Column, budget: int,
                   space: Workspace) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled texts, which cost no more than `budget` together.

    Labels are taken in the order of the hashes of their doc_id, then the texts with these ids, repeated
    rows and ids included, while there are no more than `most` and their summed `cost` (a column over
    text) keeps within the budget. Texts that cost over an eighth of it are left out, so one text never
    uses it up. Texts are whole. What is counted and ordered are ids and costs, not texts.
    """
    ids = labels.filter("label is not null").select("doc_id", F.col("label").cast("int").alias("label")).orderBy(
        F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    texts = space.keep(
        docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(ids), F.col("_id") == F.col("doc_id")).select(
            "doc_id", "text", "label", cost.cast("long").alias("cost"), F.monotonically_increasing_id().alias("row")),
        "labelled")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"), F.col("cost"), F.col("row")]
    first = texts.drop("text").filter(F.col("cost") <= budget // 8).orderBy(*order).limit(most)
    upto = F.sum("cost").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    taken = first.withColumn("upto", upto).filter(F.col("upto") <= budget).select(F.col("row").alias("_row"))
    return texts.join(F.broadcast(taken), F.col("row") == F.col("_row")).select("doc_id", "text", "label")


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of df with columns of these types after its own."""
    return T.StructType(df.schema.fields + [
        T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in columns.items()])


#: Rows of a range of an ordered table.
RANGE_ROWS = 1 << 18


def numbered(space: Workspace, df: DataFrame, group: str | None, order: list[str], name: str,
             count: str = "n") -> DataFrame:
    """df in order, with `rank` (from 0, without gaps in its group) and the group's number of rows.

    df must be a kept table. It is written in ranges of (group, order); equal rows are told apart by
    their place in df, so a common group or row is spread, too. Nulls come first. A row's rank is its
    place in its range and the rows of its group in the ranges before, summed over one row for each.
    """
    tie, part, at, own, of, first, rows, before = unused(df, "tie", "part", "at", "group", "range", "first", "rows", "before")
    keys = ([group] if group else []) + order
    parts = max(1, -(-df.count() // RANGE_ROWS))
    dealt = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(parts, *[F.col(c) for c in (*keys, tie)]).sortWithinPartitions(*keys, tie)
    place = F.monotonically_increasing_id()
    dealt = space.keep(dealt.drop(tie).withColumns({
        part: F.shiftright(place, 33), at: place.bitwiseAND((1 << 33) - 1)}), name)
    key = F.col(group) if group else F.lit(0)
    ranges = dealt.groupBy(key.alias(own), F.col(part).alias(of)).agg(F.min(at).alias(first), F.count("*").alias(rows))
    upto = Window.partitionBy(own).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn(before, F.coalesce(F.sum(rows).over(upto), F.lit(0))).withColumn(
        count, F.sum(rows).over(Window.partitionBy(own)))
    return dealt.join(ranges, (F.col(part) == F.col(of)) & key.eqNullSafe(F.col(own))).withColumn(
        "rank", F.col(at) - F.col(first) + F.col(before)).drop(part, at, own, of, first, rows, before)
