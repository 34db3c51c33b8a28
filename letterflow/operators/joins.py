"""Equi-joins with the two NULL rules in use: NULL equals NULL, or never matches."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from letterflow.operators.skew import hot_keys, null_safe, plain_equal, renamed_hot, salted

# Largest planned size of a lookup that is broadcast.
LOOKUP_BYTES = 64 * 1024 * 1024


def _pairs(on):
    if isinstance(on, str):
        return {on: on}
    return dict(on) if isinstance(on, dict) else {k: k for k in on}


def join_null_safe(left, right, on, how="left", hot_rows=None, salts=None,
                   nulls_match=True, hot=None, right_hot_rows=None, also=None,
                   right_hot=None, suffix=None):
    """Equi-join on `on` ({left: right}, a list or a name); left's key names are kept.

    `how` is inner, left, full, left_semi or left_anti. Each side is read once, and
    common keys are left to adaptive execution, which splits them in all joins but
    full ones. `hot` and `right_hot` name common keys of the two sides, as from
    `hot_keys` on a base table with this side's key names; they are spread over as
    many parts as their rows make, or over `salts`. `hot_rows` and `right_hot_rows`
    have them counted on the side itself, which reads it twice. `also` is a further
    condition.

    Columns that both sides have, keys apart, are an error unless `suffix` tells the
    right's apart.
    """
    pairs = _pairs(on)
    keys = list(pairs)
    columns = left.columns
    semi = how in ("left_semi", "left_anti")
    shared = sorted(set(columns) & set(right.columns) - set(pairs.values()))
    if shared and not semi:
        if suffix is None:
            raise ValueError(f"both sides have {', '.join(shared)}: drop, rename or give a suffix")
        right = right.withColumnsRenamed({c: f"{c}{suffix}" for c in shared})
    right = right.withColumnsRenamed({r: f"_r_{k}" for k, r in pairs.items()})
    equal = null_safe if nulls_match else plain_equal
    match = equal([(k, f"_r_{k}") for k in keys])
    if also is not None:
        if how not in ("inner", "left_semi", "left_anti"):
            raise ValueError(f"a {how} join takes no further condition")
        match = match & also
    extra = [c for c in right.columns if not c.startswith("_r_")]
    if hot is None and hot_rows is not None:
        hot = hot_keys(left, keys, hot_rows)
    if semi:
        right_hot = None
    elif right_hot is not None:
        right_hot = renamed_hot(right_hot, {r: k for k, r in pairs.items()})
    elif right_hot_rows is not None:
        right_hot = renamed_hot(hot_keys(right, [f"_r_{k}" for k in keys], right_hot_rows),
                                {f"_r_{k}": k for k in keys})
    spread = hot is not None or right_hot is not None
    if spread:
        left, right = salted(left, right, keys, hot, equal, salts, right_hot)
        match = match & (F.col("_salt") == F.col("_r__salt"))
    if semi:
        return left.join(right, match, how).select(*columns)

    if how != "inner":
        left = left.withColumn("_in_left", F.lit(True))
        right = right.withColumn("_in_right", F.lit(True))
    joined = left.join(right, match, how)
    if how != "inner" and spread:
        # A row repeated for a common key has partners on the other side, so a
        # copy that found none only met an empty part.
        stray = F.col("_in_right").isNull() & F.col("_copy")
        if how == "full":
            stray = stray | (F.col("_in_left").isNull() & F.col("_r__copy"))
        joined = joined.filter(~F.coalesce(stray, F.lit(False)))
    merged = columns
    if how == "full":
        merged = [F.when(F.col("_in_left"), F.col(c)).otherwise(F.col(f"_r_{c}")).alias(c)
                  if c in pairs else F.col(c) for c in columns]
    return joined.select(*merged, *extra)


@dataclass
class Factored:
    """A left join whose rows without a key are not multiplied out.

    `known` holds the joined rows that have one. `left` and `right` are the rows of both tables that
    have none, each distinct row once, with its number of rows `_n`: all of `left` meet all of `right`.
    """

    known: DataFrame
    left: DataFrame
    right: DataFrame
    on: list[str]

    def rows(self):
        """Rows of the whole join, without making them: known, unknown on either side, and in all."""
        parts = [df.agg(F.coalesce(F.sum(n), F.lit(0)).alias(name)) for df, n, name in (
            (self.known, F.lit(1), "known"), (self.left, F.col("_n"), "left"), (self.right, F.col("_n"), "right"))]
        tall = reduce(lambda a, b: a.unionByName(b), [
            df.select(F.lit(df.columns[0]).alias("part"), F.col(df.columns[0]).alias("n")) for df in parts])
        at = lambda name: F.max(F.when(F.col("part") == name, F.col("n")))
        return tall.agg(at("known").alias("known"), at("left").alias("left"), at("right").alias("right")).withColumn(
            "total", F.col("known") + F.col("left") * F.greatest(F.col("right"), F.lit(1)))

    def expanded(self):
        """The whole join, row for row."""
        right = self.right.withColumnRenamed("_n", "_m")
        both = join_null_safe(self.left, right, self.on, "left")
        times = (F.col("_n") * F.coalesce("_m", F.lit(1))).cast("int")
        return self.known.unionByName(
            both.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).select(*self.known.columns))


def factored_join(left, right, on, hot=None, right_hot=None):
    """`join_null_safe(left, right, on, "left")` with the rows without any key kept apart, as `Factored`.

    Rows whose keys are all NULL match each other, so a third of each table without a key would give
    a ninth of their product. Here they cost one aggregate a side.
    """
    keys = [on] if isinstance(on, str) else list(on)
    unknown = reduce(lambda a, b: a & b, [F.col(k).isNull() for k in keys])
    known = join_null_safe(left.filter(~unknown), right.filter(~unknown), keys, "left", hot=hot, right_hot=right_hot)
    apart = [df.filter(unknown).groupBy(*df.columns).agg(F.count("*").alias("_n")) for df in (left, right)]
    return Factored(known, *apart, keys)


def planned_bytes(df):
    """Spark's own size estimate of a table, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(left, lookup, on, how="left", max_bytes=LOOKUP_BYTES, hot_rows=None):
    """Join to a lookup: broadcast if its planned size allows, else spread by key."""
    if planned_bytes(lookup) <= max_bytes:
        return join_null_safe(left, F.broadcast(lookup), on, how)
    return join_null_safe(left, lookup, on, how, hot_rows=hot_rows)


def anti_join_sql(left, right, on, hot_rows=None):
    """`NOT IN` as meant: known left keys that are not among right's known keys."""
    pairs = _pairs(on)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in pairs])
    keys = right.select(*pairs.values()).na.drop().distinct()
    return join_null_safe(left.filter(known), keys, pairs, "left_anti", hot_rows,
                          nulls_match=False)


def semi_flag(left, right, col, right_col=None, out="matched", hot_rows=None):
    """Mark left rows whose value occurs on the right (NULL occurs if NULL does)."""
    right_col = right_col or col
    values = right.select(right_col).distinct().withColumn("_found", F.lit(True))
    joined = join_null_safe(left, values, {col: right_col}, "left", hot_rows)
    return joined.withColumn(out, F.coalesce("_found", F.lit(False))).drop("_found")
