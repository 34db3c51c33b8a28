"""Keeping one very common key from landing in one task.

Adaptive execution splits skewed joins by itself (see `settings.CLUSTER`), but never
windows or full joins. For those the common keys are found once, by `hot_keys` on the
narrow base table, and passed along as `hot`; nothing here counts a derived table
unless it is asked to. Rows without a key need no count: they are spread by rule.
"""

from functools import reduce

from pyspark.sql import Window, functions as F

# Rows above which a key counts as common. A group of this size sorts in one task.
HOT_ROWS = 1_000_000
# Below this the table of common keys could be too large to broadcast.
LEAST_HOT_ROWS = 10_000

LANE = "_lane"


def null_safe(pairs):
    """Equality of column pairs where NULL equals NULL."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])


def plain_equal(pairs):
    """Equality of column pairs where NULL equals nothing."""
    return reduce(lambda a, b: a & b, [F.col(x) == F.col(y) for x, y in pairs])


def hot_keys(df, keys, hot_rows=HOT_ROWS, rows=None):
    """Keys (NULL included) with more than `hot_rows` rows, as columns `_h_<key>`.

    `_h_parts` says how many parts of `hot_rows` rows a key makes. `rows` names a
    column that already holds the rows per key; without it they are counted. There
    are at most rows / hot_rows common keys, so broadcasting them is safe: a trillion
    rows give fewer than a million keys.
    """
    if hot_rows < LEAST_HOT_ROWS:
        raise ValueError(f"hot_rows must be at least {LEAST_HOT_ROWS}")
    if rows is None:
        rows = "_rows"
        df = df.groupBy(*keys).agg(F.count("*").alias(rows))
    hot = df.filter(F.col(rows) > hot_rows)
    parts = F.ceil(F.col(rows) / max(hot_rows, 1)).cast("int")
    return F.broadcast(hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys],
                                  parts.alias("_h_parts")))


def frequent_keys(sides, key, hot_rows=HOT_ROWS, most=1000, tracked=10_000):
    """For each of several tables, its common keys as from `hot_keys`, by one sketch over one pass of each.

    A frequent-items sketch of `tracked` counters a table finds every key with more than four
    in `tracked` of its rows, the `most` commonest of them; their counts are off by less. Keys with
    more than `hot_rows` rows count as common. At most `most` keys a table are broadcast,
    whatever the tables hold, so nothing needs to be known of them. NULL is no key here:
    in joins where NULL equals NULL name it by `hot_keys`.
    """
    marked = reduce(lambda a, b: a.unionByName(b), [
        df.select(F.lit(k).alias("_side"), F.col(key).alias("_key")) for k, df in enumerate(sides)])
    found = marked.filter(F.col("_key").isNotNull()).groupBy("_side").agg(
        F.expr(f"approx_top_k(_key, {most}, {tracked})").alias("_top")).select("_side", F.inline("_top"))
    parts = F.ceil(F.col("count") / max(hot_rows, 1)).cast("int")
    return [F.broadcast(found.filter((F.col("_side") == k) & (F.col("count") > hot_rows)).select(
        F.col("item").alias(f"_h_{key}"), parts.alias("_h_parts"))) for k in range(len(sides))]


def renamed_hot(hot, names):
    """Common keys under other key names ({old: new})."""
    return hot.withColumnsRenamed({f"_h_{old}": f"_h_{new}" for old, new in names.items()})


def _near_ends(run, order, keep):
    """True for the first and last `keep` rows of each run, from one sort."""
    position = F.row_number().over(Window.partitionBy(*run).orderBy(*order))
    size = F.count("*").over(Window.partitionBy(*run))
    return (position <= keep) | (position > size - keep)


def in_lanes(df, group, run, order, keep, hot_rows=None, hot=None):
    """Add `_lane` so that windows over (group, _lane) stay small.

    `run` names a finer key than `group`; rows of one run are neighbours in
    `order`. The caller promises that only the first and last `keep` rows of a
    run can affect, or be affected by, a row of another run. Those rows share
    lane 0, where neighbours are exact. The inner rows of long runs go to other
    lanes, no larger than an input partition, and the caller gives them their
    result without neighbours. Groups that are not common stay whole in lane 0.

    Rows without a group have no neighbours by the caller's rules, so they are
    spread by input partition, without a count. `hot` names the common groups, as
    from `hot_keys` on a base table; `hot_rows` has them counted here. With neither
    the input is read once. No row is dropped or repeated.
    """
    unknown = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in group])
    spread = F.when(unknown, F.spark_partition_id() + 1).otherwise(0)
    if hot is None and hot_rows is not None:
        hot = hot_keys(df, group, hot_rows)
    if hot is None:
        return df.withColumn(LANE, spread)
    # A NULL group is spread by rule, so it is no common one.
    is_hot = plain_equal([(k, f"_h_{k}") for k in group])
    calm = df.join(hot, is_hot, "left_anti").withColumn(LANE, spread)

    # The input partition number splits even a group of identical rows, and
    # is the same again when a lost task is run anew.
    busy = df.join(hot, is_hot, "left_semi").withColumn("_part", F.spark_partition_id() + 1)
    # First the ends of each run within an input partition, then among those.
    busy = busy.withColumn("_inner", ~_near_ends([*run, "_part"], order, keep))
    busy = busy.withColumn("_bin", F.when(F.col("_inner"), F.col("_part")).otherwise(0))
    ends = _near_ends([*run, "_bin"], order, keep) & ~F.col("_inner")
    busy = busy.withColumn(LANE, F.when(ends, 0).otherwise(F.col("_part")))
    return calm.unionByName(busy.drop("_part", "_inner", "_bin"))


def _spread(df, keys, prefix, own, other, equal, salts):
    """Give each row a `<prefix>_salt`, by which common keys are spread in a join.

    A key has `salts` parts, or as many as its rows make. Rows of a key common on
    this side (`own`) take the salt of their input partition. Rows of a key common on the `other` side are repeated for every
    salt, and `<prefix>_copy` marks them.
    """
    salt, copy = f"{prefix}_salt", f"{prefix}_copy"
    names = {k: f"{prefix}{k}" for k in keys}
    marks = F.array(F.lit(0))
    single = F.lit(0)
    df = df.withColumn(copy, F.lit(False))
    if other is not None:
        pairs = [(names[k], f"_h_{k}") for k in keys]
        df = (df.drop(copy).join(F.broadcast(other.withColumn(copy, F.lit(True))), equal(pairs), "left")
              .withColumn(copy, F.coalesce(copy, F.lit(False))).drop(*[f"_h_{k}" for k in keys]))
        parts = F.col("_h_parts") if salts is None else F.lit(salts)
        df = df.withColumn("_copies", F.when(F.col(copy), parts)).drop("_h_parts")
        marks = F.when(F.col(copy), F.sequence(F.lit(0), F.col("_copies") - 1)).otherwise(marks)
    if own is not None:
        pairs = [(names[k], f"_h_{k}") for k in keys]
        df = df.join(F.broadcast(own.withColumn("_hot", F.lit(True))), null_safe(pairs), "left")
        here = F.spark_partition_id() % (F.col("_h_parts") if salts is None else F.lit(salts))
        marks = F.when(F.col("_hot"), F.array(here)).otherwise(marks)
        single = F.when(F.col("_hot"), here).otherwise(0)
    # Without keys common elsewhere each row has one salt and needs no explode.
    df = df.withColumn(salt, single if other is None else F.explode(marks))
    return df.drop("_hot", "_h_parts", "_copies", *[f"_h_{k}" for k in keys])


def salted(left, right, keys, hot, equal, salts=None, right_hot=None):
    """Both sides of a join with `_salt` and `_r__salt`; their equality joins the join.

    `right` carries its keys as `_r_<key>`. `hot` and `right_hot` are the common
    keys of each side. A key common on both counts as the left's. `equal` is the
    rule of the join: a NULL that matches nothing is spread, not repeated.
    """
    if hot is not None and right_hot is not None:
        left_keys = hot.select(*[F.col(f"_h_{k}").alias(f"_g_{k}") for k in keys])
        right_hot = right_hot.join(F.broadcast(left_keys),
                                   equal([(f"_h_{k}", f"_g_{k}") for k in keys]), "left_anti")
    return (_spread(left, keys, "", hot, right_hot, equal, salts),
            _spread(right, keys, "_r_", right_hot, hot, equal, salts))
