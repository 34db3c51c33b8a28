"""Tables in order, dealt into ranges that no key decides, and what stands beside a row across their ends.

A person or letter with any share of all rows is cut like any other: ranges follow the
order of the rows, not their keys, so no list of common keys is needed. The table is
shuffled and written once; what a row needs of the ranges before and after its own are
a few rows at their ends, which are broadcast.
"""

from functools import reduce

from pyspark.sql import Window, functions as F

from letterflow.sources.sink import keep_bucketed

# Rows of a range, about, and ranges there may be: their ends are broadcast. Ranges are hashed to as many
# buckets, so a few meet in one task, which sorts all of them: a range is small against what a task can hold.
RANGE_ROWS = 1 << 17
MOST_RANGES = 1 << 16

PART, AT, SIZE = "_part", "_at", "_size"
BEFORE, AFTER = "_before", "_after"


def ranged(df, order, path):
    """The rows in the order of the columns `order` (NULL last), with range `_part` and place `_at` in it.

    Kept in `path`, bucketed by range. Rows equal in all of `order` are told apart by their
    place in `df`, so copies of one row are spread as well. Runs jobs: it counts the rows,
    and Spark samples them for the ranges' bounds.
    """
    spark = df.sparkSession
    parts = min(MOST_RANGES, max(spark.sparkContext.defaultParallelism, -(-df.count() // RANGE_ROWS)))
    keys = [F.asc_nulls_last(c) for c in order] + [F.col("_tie")]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
    rows = rows.sortWithinPartitions(*keys).drop("_tie").withColumns({
        PART: F.spark_partition_id(),
        AT: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    return keep_bucketed(rows, path, PART, parts)


def sizes(rows):
    """`_part` and `_size`, its number of rows. One row for each range."""
    return rows.groupBy(PART).agg((F.max(AT) + 1).alias(SIZE))


def ends(rows, count):
    """The first and last `count` rows of each range, with `_size`.

    In the order of (`_part`, `_at`), the rows on both sides of each bound between ranges are
    neighbours here as they are in the whole table. At most 2 * count rows a range.
    """
    known = rows.join(F.broadcast(sizes(rows)), PART)
    return known.filter((F.col(AT) < count) | (F.col(AT) >= F.col(SIZE) - count))


def in_order():
    """The window over all ends of ranges, of which there are few."""
    return Window.orderBy(PART, AT)


def with_halos(rows, known, fields, back=0, ahead=0):
    """Add what stands before and after each range: `fields` of up to `back` and `ahead` rows.

    `known` are the `ends` of the ranges with these fields.
    """
    beside = F.collect_list(F.struct(*fields))
    known = known.withColumns({
        BEFORE: beside.over(in_order().rowsBetween(-max(back, 1), -1)),
        AFTER: beside.over(in_order().rowsBetween(1, max(ahead, 1)))})
    first = known.filter(F.col(AT) == 0).select(PART, SIZE, BEFORE)
    last = known.filter(F.col(AT) == F.col(SIZE) - 1).select(F.col(PART).alias("_of"), AFTER)
    halos = first.join(last, F.col(PART) == F.col("_of")).drop("_of")
    return rows.join(F.broadcast(halos), PART)


def without_halos(df):
    return df.drop(PART, AT, SIZE, BEFORE, AFTER)


class InWindow:
    """What stands beside a row within a window."""

    def __init__(self, w):
        self.w = w

    def at(self, name, k):
        """The value `k` rows on, back if negative; NULL beyond the window."""
        return F.lead(name, k).over(self.w)


class AcrossRanges:
    """What stands beside a row of the same group, wherever the ranges are cut.

    Rows are those of `with_halos`. Values beyond the ends of the row's range are read from the
    halos, which must hold the group's columns and the value.
    """

    def __init__(self, group):
        self.group = group
        self.w = Window.partitionBy(PART).orderBy(AT)

    def _value(self, name, k):
        inside = F.lead(name, k).over(self.w)
        if k < 0:
            beyond = F.try_element_at(BEFORE, -F.greatest(-k - F.col(AT), F.lit(1)).cast("int"))
            return F.when(F.col(AT) >= -k, inside).otherwise(beyond[name])
        over = F.col(AT) + k - F.col(SIZE) + 1
        beyond = F.try_element_at(AFTER, F.greatest(over, F.lit(1)).cast("int"))
        return F.when(over <= 0, inside).otherwise(beyond[name])

    def at(self, name, k):
        same = reduce(lambda a, b: a & b, [self._value(g, k).eqNullSafe(F.col(g)) for g in self.group])
        return F.when(same, self._value(name, k))
