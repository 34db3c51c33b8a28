"""Prescriptions: split doses put together into one total daily dose in mg."""

from pyspark.sql import DataFrame, Window, functions as F

from letterflow.functions.lookups import ONCE_DAILY_CODES, generic_names
from letterflow.functions.scalars import round2, safe_divide
from letterflow.operators.joins import lookup_join
from letterflow.operators.ranges import (
    AT, PART, AcrossRanges, InWindow, ends, ranged, with_halos, without_halos)
from letterflow.operators.skew import LANE, in_lanes

# Order of the rows of a letter. The columns after END only settle ties.
DOSE_ORDER = ("START", "CUI", "END", "FREQUENCY", "DOSE", "UNIT", "NAME")
# Rows of this run look alike to the split-dose rules, but for the quantity.
RUN = ("START", "CUI", "END", "FREQUENCY")
# Two rows back, the row itself, and as many ahead.
REACH = 3


def quantity_mg(df, dose="DOSE", unit="UNIT", out="Quantity_mg"):
    return df.withColumn(out, F.when(F.col(unit) == "mg", F.col(dose))
                         .when(F.col(unit) == "g", F.col(dose) * 1000))


def _ascending(columns):
    return [F.asc_nulls_last(c) for c in columns]


def _group(doc, order):
    """What neighbours share.

    All rules compare START, so under an order led by START the span is part of
    the group; rows of other spans are then seen as absent, which reads the
    same as a different START.
    """
    return [doc, "START"] if order[0] == "START" else [doc]


def _near(doc, order):
    """Neighbours within a letter."""
    return InWindow(Window.partitionBy(*_group(doc, order), LANE).orderBy(*_ascending(order)))


def _in_lanes(df, doc, order, hot_rows, hot=None):
    if order[0] != "START":
        # Only letters' own rows can be interleaved; those of no letter are spread. A common
        # letter is cut only by `total_daily_dose` with a path.
        return in_lanes(df, [doc], [doc, *RUN], _ascending(order), REACH)
    return in_lanes(df, [doc], [doc, *RUN], _ascending(order), REACH, hot_rows, hot)


def _beside(df, near, offsets):
    """Columns `_<name><k>`: the value k rows on (back if negative), for {name: [k, ...]}."""
    return df.withColumns({_at(name, k): near.at(name, k)
                           for name, ks in offsets.items() for k in ks})


def _at(name, k):
    return f"_{name}{k:+d}"


def _without(df, offsets):
    return df.drop(*[_at(name, k) for name, ks in offsets.items() for k in ks])


def _flag(df, doc, near):
    seen = {"START": (-1, -2), "CUI": (-1, -2), "FREQUENCY": (-1, -2)}
    start = {k: F.col(_at("START", k)) for k in (-1, -2)}
    same_start = {k: F.col("START") == start[k] for k in start}
    same_code = {k: F.col("CUI") == F.col(_at("CUI", k)) for k in start}
    single = {k: (F.col("FREQUENCY") == 1) & (F.col(_at("FREQUENCY", k)) == 1) for k in start}
    other = {k: F.col("START") != start[k] for k in start}
    neighbours = (
        F.when(same_start[-1] & (start[-2].isNull() | other[-2]) & same_code[-1] & single[-1], "2nd")
        .when(same_start[-1] & same_start[-2] & same_code[-1] & same_code[-2] & single[-2], "3rd")
        .when(same_start[-2] & other[-1] & single[-2], "2nd"))
    # Inside a long run the two rows before are of the same code and frequency.
    inner = F.when(F.col("START").isNotNull() & F.col("CUI").isNotNull()
                   & (F.col("FREQUENCY") == 1), "3rd")
    flag = F.when(F.col(LANE) == 0, neighbours).otherwise(inner)
    rows = _beside(df, near, seen).withColumn("AnotherDose", F.when(F.col(doc).isNotNull(), flag))
    return _without(rows, seen)


def _quantities(df, near, rule):
    seen = {"START": (-1, -2), "CUI": (-1, -2), "Quantity_mg": (-1, -2, 1), "AnotherDose": (1,)}
    second = F.col("AnotherDose") == "2nd"
    if rule == "previous":
        q2 = F.when(second, F.col(_at("Quantity_mg", -1)))
    elif rule == "matched":
        alike = {k: (F.col("START") == F.col(_at("START", k)))
                 & (F.col("CUI") == F.col(_at("CUI", k))) for k in (-1, -2)}
        q2 = (F.when(second & alike[-1], F.col(_at("Quantity_mg", -1)))
              .when(second & alike[-2], F.col(_at("Quantity_mg", -2))))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    third = F.col(_at("AnotherDose", 1)) == "3rd"
    q3 = F.when(second & third, F.col(_at("Quantity_mg", 1)))
    return _without(_beside(df, near, seen).withColumns({"Q2ndDose": q2, "Q3rdDose": q3}), seen)


def _daily(df, doc, near, null_freq_codes):
    seen = {"START": (1, 2)}
    quantity, frequency = F.col("Quantity_mg"), F.col("FREQUENCY")
    second = F.col("AnotherDose") == "2nd"
    unflagged = F.col("AnotherDose").isNull()
    alone = F.col("START").isNotNull() & (F.col(LANE) == 0)
    for k in seen["START"]:
        ahead = F.col(_at("START", k))
        alone = alone & (ahead.isNull() | (ahead != F.col("START")))
    # A row of no known letter has no neighbours.
    alone = alone | (F.col("START").isNotNull() & F.col(doc).isNull())
    daily = (
        F.when(frequency > 1, quantity * frequency)
        .when(second & F.col("Q3rdDose").isNotNull(),
              quantity + F.col("Q2ndDose") + F.col("Q3rdDose"))
        .when(second, quantity + F.col("Q2ndDose"))
        .when(unflagged & F.col("Q2ndDose").isNull() & F.col("Q3rdDose").isNull()
              & alone & (frequency == 1), quantity)
        .when(frequency.isNull() & unflagged & F.col("CUI").isin(*null_freq_codes), quantity))
    return _without(_beside(df, near, seen).withColumn("DailyDose", daily), seen)


def split_dose_flag(df, doc="LETTER", order=DOSE_ORDER, hot_rows=None, hot=None):
    """`AnotherDose`: is this row the 2nd or 3rd part of a dose in the same span?

    An order not led by START is allowed for rows with interleaved spans; the
    window then covers the whole letter. `hot` names letters too common for one
    task, as from `hot_keys` on a base table.
    """
    return _flag(_in_lanes(df, doc, order, hot_rows, hot), doc, _near(doc, order)).drop(LANE)


def split_dose_qty(df, rule="matched", doc="LETTER", order=DOSE_ORDER, hot_rows=None,
                   hot=None):
    """`Q2ndDose`, `Q3rdDose`: the other parts of the dose, on the 2nd part's row.

    "matched" takes the nearest of two rows back with the same span and code,
    "previous" always takes the row before.
    """
    rows = _in_lanes(df, doc, order, hot_rows, hot)
    return _quantities(rows, _near(doc, order), rule).drop(LANE)


def daily_dose(df, null_freq_codes=ONCE_DAILY_CODES, doc="LETTER", order=DOSE_ORDER,
               hot_rows=None, hot=None):
    """`DailyDose` from the flag, the quantities and the following rows."""
    rows = _in_lanes(df, doc, order, hot_rows, hot)
    return _daily(rows, doc, _near(doc, order), null_freq_codes).drop(LANE)


def total_daily_dose(df, rule="matched", null_freq_codes=ONCE_DAILY_CODES, doc="LETTER",
                     order=DOSE_ORDER, hot_rows=None, hot=None, path=None):
    """Quantity, split doses and daily dose in one go: one shuffle, one sort.

    A letter's rows (under an order led by START, a span's) meet in one task. `hot` names
    letters too common for that. With `path`, a new folder, no list is needed, and any
    order will do: the rows are kept there in order, in ranges that cut any letter, and
    neighbours are found across the ranges' ends. Results are the same.
    """
    rows = quantity_mg(df)
    if path is None:
        near = _near(doc, order)
        rows = _in_lanes(rows, doc, order, hot_rows, hot)
        rows = _quantities(_flag(rows, doc, near), near, rule)
        return _daily(rows, doc, near, null_freq_codes).drop(LANE)
    group = _group(doc, order)
    rows = ranged(rows, [doc, *order], path).withColumn(LANE, F.lit(0))
    beside = InWindow(Window.partitionBy(*group).orderBy(PART, AT))
    # The flag of the next row follows from rows up to two before it.
    known = _flag(ends(rows, 2 * REACH), doc, beside)
    fields = [*group, "START", "CUI", "FREQUENCY", "Quantity_mg", "AnotherDose"]
    rows = with_halos(rows, known, list(dict.fromkeys(fields)), back=REACH - 1, ahead=REACH - 1)
    near = AcrossRanges(group)
    rows = _quantities(_flag(rows, doc, near), near, rule)
    return without_halos(_daily(rows, doc, near, null_freq_codes).drop(LANE))


def generic_name(df, name_map=None, out="PREF"):
    """Generic name by medicine name or code; the earliest entry of the map wins.

    `name_map` is a sequence of (generic, column, value), or a table with
    columns match_col, value, priority, generic.
    """
    if isinstance(name_map, DataFrame):
        hits = []
        for column in ("NAME", "CUI"):
            hit = f"_by_{column}"
            table = (name_map.filter(F.col("match_col") == column).groupBy("value")
                     .agg(F.min(F.struct("priority", "generic")).alias(hit)))
            df = lookup_join(df, table, {column: "value"})
            hits.append(hit)
        return df.withColumn(out, F.least(*hits)["generic"]).drop(*hits)

    by_column = {"NAME": {}, "CUI": {}}
    for priority, (generic, column, value) in enumerate(name_map or generic_names()):
        by_column[column].setdefault(value, (priority, generic))
    found = []
    for column, entries in by_column.items():
        if entries:
            pairs = [x for value, (priority, generic) in entries.items()
                     for x in (F.lit(value), F.struct(F.lit(priority).alias("priority"),
                                                      F.lit(generic).alias("generic")))]
            found.append(F.try_element_at(F.create_map(*pairs), F.col(column)))
    best = F.least(*found) if len(found) > 1 else found[0]
    return df.withColumn(out, best["generic"])


CLEAN_KEYS = ("SYSTEM_ID", "LETTER", "DATEREC", "CUI", "PREF")
CLEAN_KEYS_BY_PERSON = ("SYSTEM_ID", "DATEREC", "CUI", "PREF")
CLEAN_KEYS_BY_NAME = ("SYSTEM_ID", "DATEREC", "DOC", "CUI", "NAME")


def daily_dose_clean(df, keys=CLEAN_KEYS):
    """Keys and daily dose; rows with any NULL and repeats are dropped."""
    return df.select(*keys, "DailyDose").na.drop("any").distinct()


def max_daily_dose(df, keys=CLEAN_KEYS):
    """Largest daily dose per key. Repeats need not be removed first."""
    complete = df.select(*keys, "DailyDose").na.drop("any")
    return complete.groupBy(*keys).agg(F.max("DailyDose").alias("DailyDose"))


def max_dose_row(df, keys=("SYSTEM_ID", "DATEREC", "DOC", "CUI"), tie="NAME"):
    """The row with the largest daily dose per key; the smallest `tie` among equals."""
    complete = df.select(*keys, tie, "DailyDose").na.drop("any")
    # The greatest dose sorts first once negated.
    best = F.min(F.struct((-F.col("DailyDose")).alias("less"), F.col(tie))).alias("best")
    return complete.groupBy(*keys).agg(best).select(
        *keys, F.col(f"best.{tie}").alias(tie), (-F.col("best.less")).alias("DailyDose"))


def dose_ratio(df, top_doses):
    """Daily dose as a share of the medicine's top dose, two decimals."""
    top = top_doses.select("ASM", F.col("Dose").alias("TopDose"))
    return lookup_join(df, top, {"PREF": "ASM"}).withColumn(
        "DailyRate", round2(safe_divide("DailyDose", "TopDose")))


def rows_per(df, key, out="n"):
    """Rows per key."""
    return df.groupBy(key).agg(F.count("*").alias(out))
