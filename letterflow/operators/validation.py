"""Extracted values against a trusted list, and checks of the date table."""

from pyspark.sql import functions as F

from letterflow.functions.scalars import parse_dmy
from letterflow.operators.joins import (
    LOOKUP_BYTES, anti_join_sql, join_null_safe, planned_bytes, semi_flag)
from letterflow.operators.skew import hot_keys
from letterflow.sources.sink import keep

# Pairs of one extracted row that are made at once, and tasks a core that share all pairs.
PAIRS_AT_ONCE = 4096
TASKS_PER_CORE = 4


def membership(a, b, col, b_col=None, hot_rows=None):
    """Rows of `a` with `matched`: does the value occur in `b`?"""
    return semi_flag(a, b, col, b_col, "matched", hot_rows)


def matched_values(a, b, col, b_col=None, hot_rows=None):
    """The values of `a` that occur in `b`, as often as in `a`."""
    keys = b.select(b_col or col).distinct()
    return join_null_safe(a.select(col), keys, {col: b_col or col}, "left_semi", hot_rows)


def value_overlap(a, b, col, b_col=None):
    """Distinct known values only in `a`, in both, only in `b`."""
    sides = (a.select(F.col(col).alias("value"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
             .unionByName(b.select(F.col(b_col or col).alias("value"), F.lit(0).alias("in_a"),
                                   F.lit(1).alias("in_b"))))
    values = (sides.filter(F.col("value").isNotNull()).groupBy("value")
              .agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b")))

    def count(condition):
        return F.count(F.when(condition, 1))

    return values.agg(
        count((F.col("in_a") == 1) & (F.col("in_b") == 0)).alias("only_a"),
        count((F.col("in_a") == 1) & (F.col("in_b") == 1)).alias("both"),
        count((F.col("in_a") == 0) & (F.col("in_b") == 1)).alias("only_b"))


def value_match(a, b, col, b_col=None, id="SYSTEM_ID", out=None, hot_rows=None):
    """Each extracted value next to the equal trusted value.

    A value held by many trusted people is not written out once per pair:
    `n_trusted` says how many trusted rows hold it.
    """
    b_col, out = b_col or col, out or f"TRUSTED_{col}"
    trusted = (b.filter(F.col(b_col).isNotNull()).groupBy(F.col(b_col).alias("_value"))
               .agg(F.count("*").alias("n_trusted")).withColumn(out, F.col("_value")))
    joined = join_null_safe(a.select(id, col), trusted, {col: "_value"}, "left", hot_rows)
    return joined.select(id, col, out, F.coalesce("n_trusted", F.lit(0)).alias("n_trusted"))


def value_links(a, b, col, b_col=None):
    """Classes of equal values: how many rows of each table hold one, and how many pairs they make.

    Known values only, as NULL matches nothing. With `value_match` and `value_pairs` this is the whole
    many-to-many join: no pair of a common value is written out to know of it.
    """
    sides = (a.select(F.col(col).alias("value"), F.lit(1).alias("a"), F.lit(0).alias("b"))
             .unionByName(b.select(F.col(b_col or col).alias("value"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    return (sides.filter(F.col("value").isNotNull()).groupBy("value")
            .agg(F.sum("a").alias("n_extracted"), F.sum("b").alias("n_trusted"))
            .withColumn("links", F.col("n_extracted") * F.col("n_trusted")))


def value_pairs(a, b, col, b_col=None, id="SYSTEM_ID", out=None, hot_rows=None):
    """Each extracted value once for every trusted row with that value, or once with NULL.

    The join itself, row for row. It is read from `value_match`: an extracted row stands
    as often as trusted rows hold its value, so no pair of tables is joined many to many.
    Rows are dealt out in pieces before they are repeated, so the pairs are shared by all cores
    however the input is split, and no task holds more than `PAIRS_AT_ONCE` at a time. There are
    as many rows as pairs, which grow with the product of the tables.
    """
    out = out or f"TRUSTED_{col}"
    matched = value_match(a, b, col, b_col, id, out, hot_rows).withColumn("_n", F.greatest("n_trusted", F.lit(1)))
    pieces = matched.withColumn("_piece", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / PAIRS_AT_ONCE))))
    left = F.col("_n") - F.col("_piece") * PAIRS_AT_ONCE
    pieces = pieces.select(id, col, out, F.least(left, F.lit(PAIRS_AT_ONCE)).cast("int").alias("_times"))
    tasks = TASKS_PER_CORE * a.sparkSession.sparkContext.defaultParallelism
    times = F.array_repeat(F.lit(0), F.col("_times"))
    return pieces.repartition(tasks).withColumn("_pair", F.explode(times)).select(id, col, out)


def value_match_by_id(a, b, col, id="SYSTEM_ID", b_col=None, hot_rows=None):
    """One value per person, and whether any of the person's values is trusted."""
    b_col = b_col or col
    values = b.select(b_col).na.drop()
    flagged = semi_flag(a.select(id, col).distinct(), values, col, b_col, "_hit", hot_rows)
    return flagged.groupBy(id).agg(F.min(col).alias(col), F.max("_hit").alias("matched"))


def annotations_per_id(df, key="SYSTEM_ID", out="n"):
    """Annotations per person."""
    return df.groupBy(key).agg(F.count(key).alias(out))


def missed_ids(trusted, extracted, id="SYSTEM_ID", hot_rows=None):
    """Trusted people without any extracted value."""
    return anti_join_sql(trusted.select(id), extracted, id, hot_rows)


def clinic_letter_full(clinic, letter, on="LETTER", hot_rows=None, hot=None, right_hot=None):
    """Clinic and letter dates side by side, keeping letters that have only one.

    Adaptive execution doesn't split a full join: `hot` and `right_hot` name the letters that are
    common in the clinic dates and the letter dates, as from `frequent_keys`.
    """
    both = join_null_safe(clinic.select(on, "Clinic_Date"), letter.select(on, "LetDate"), on,
                          "full", hot_rows, hot=hot, right_hot_rows=hot_rows, right_hot=right_hot)
    return both.select(on, "Clinic_Date", "LetDate")


def dates_with_letters(dates, letters, on="LETTER", hot_rows=None, suffix=None, hot=None, right_hot=None):
    """The date table next to the letter list, keeping what is in only one.

    Both may have a person id: `suffix` tells the list's columns apart. `hot` and `right_hot` as
    in `clinic_letter_full`.
    """
    return join_null_safe(dates, letters, on, "full", hot_rows, hot=hot, right_hot_rows=hot_rows,
                          right_hot=right_hot, suffix=suffix)


def duplicate_rows(df, key="DOC", hot_rows=None, path=None):
    """Rows whose key occurs more than once (NULL is a key like any other).

    The rows are read twice, to count keys and to find them. With `path`, a new folder, they are
    kept there first, so whatever made them is evaluated once, and counting reads the key alone.
    """
    if path is not None:
        df = keep(df, path)
    counts = df.groupBy(key).agg(F.count("*").alias("_rows"))
    hot = None if hot_rows is None else hot_keys(counts, [key], hot_rows, "_rows")
    repeated = counts.filter(F.col("_rows") > 1).drop("_rows")
    return join_null_safe(df, repeated, key, "left_semi", hot_rows, hot=hot)


def sample_dates(sample, dates, on="LETTER", max_bytes=LOOKUP_BYTES, hot_rows=None):
    """The dates of a sample of letters."""
    if planned_bytes(sample) <= max_bytes:
        # A small sample first cuts the date table down, without a shuffle of it.
        wanted = F.broadcast(sample.select(on).distinct())
        dates = join_null_safe(dates, wanted, on, "left_semi", hot_rows=None)
        hot_rows = None
    return join_null_safe(sample, dates, on, "left", hot_rows)


def without_clinic_date(df, clinic="Clinic_Date"):
    return df.filter(F.col(clinic).isNull())


def date_order_check(df, clinic="Clinic_Date", letter="LetDate"):
    """Rows whose clinic date is later than the letter date."""
    types = dict(df.dtypes)
    for name in (clinic, letter):
        if types[name] == "string":
            df = df.withColumn(name, parse_dmy(name))
    return df.filter(F.col(clinic) > F.col(letter))
