"""Seizure reports: counts, periods and phrases turned into a daily rate and a severity.

Two rule sets exist, "basic" and "expanded"; where they agree there is no
`variant` argument.
"""

from pyspark.sql import Window, functions as F

from letterflow.functions.lookups import (
    FREE_DAYS_BELOW, FREE_DAYS_LONGEST, PERIOD_DAYS, POINT_IN_TIME_DAYS, RATE_ABOVE,
    RATE_LOWEST, WEEKS_PER_MONTH)
from letterflow.functions.scalars import date_from_parts, safe_divide
from letterflow.operators.joins import join_null_safe, lookup_join
from letterflow.operators.ranges import (
    AT, PART, AcrossRanges, InWindow, ends, ranged, with_halos, without_halos)
from letterflow.operators.skew import LANE, hot_keys, in_lanes

VARIANTS = ("basic", "expanded")
# Rows looked back over for an earlier report of the same seizure type.
DEPTH = 6
# Days in about half a year.
HALF_YEAR = 183

PERSON = "SYSTEM_ID"
# The annotation after date and code, then its content; only ties reach the content.
ORDER = ("DATEREC", "CUI", "LETTER", "DOC", "Start", "End", "FreqChange", "NofS", "UNofS", "TP",
         "NofTP", "LNofTP", "Sin_Dur", "YD", "MD", "DD", "PinT")


def _check(variant):
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    return variant == "expanded"


def _order(df):
    return [F.asc_nulls_last(c) for c in ORDER if c in df.columns]


def _history(df, hot_rows=None, hot=None):
    """The rows in lanes, and what stands beside a row of a person in time order.

    Only the ends of a date's rows meet other dates, and a person has few dates,
    so lane 0 of a person is small whatever the number of rows.
    """
    order = _order(df)
    rows = in_lanes(df, [PERSON], [PERSON, "DATEREC"], order, DEPTH, hot_rows, hot)
    return rows, InWindow(Window.partitionBy(PERSON, LANE).orderBy(*order))


# --- row by row ------------------------------------------------------------------------

def event_count(df, variant="expanded"):
    """`NumS`: number of seizures, else the upper end of a range if above zero."""
    count = F.coalesce("NofS", F.when(F.col("UNofS") > 0, F.col("UNofS")))
    if _check(variant):
        span = F.col("Sin_Dur")
        during = span == "During"
        weekly = F.coalesce(F.col("TP") == "Week", F.lit(False))
        count = (F.when(span.isNull() | (span == "Since"), count)
                 .when(during & ~weekly, count)
                 .when(during & F.col("MD").isNotNull(), WEEKS_PER_MONTH * count))
    return df.withColumn("NumS", count)


def period_count(df):
    """`NTP`: number of periods, else the lower end of a range (the more frequent)."""
    given, lower = F.col("NofTP"), F.col("LNofTP")
    return df.withColumn(
        "NTP", F.when(given > 0, given).when(given.isNull() & (lower > 0), lower))


def period_days(df):
    """`Days` in one stated period and `TotalTPDays` in all of them."""
    days = F.lit(None).cast("int")
    for period, length in PERIOD_DAYS.items():
        days = F.when(F.col("TP") == period, length).otherwise(days)
    return df.withColumns({"Days": days, "TotalTPDays": days * F.col("NTP")})


def stated_rate(df, variant="expanded"):
    """`DailyRate` from the stated period; expanded: not with since or during."""
    if _check(variant):
        rate = F.when(F.col("Sin_Dur").isNull(), safe_divide("NumS", "TotalTPDays"))
    else:
        rate = safe_divide(safe_divide("NumS", "NTP"), "Days")
    return df.withColumn("DailyRate", rate)


def event_date(df):
    """`EventDate` from the parts given and `EventDate2` from a point in time in words.

    A month without a year is the last such month before the record's month.
    """
    year, month, day = F.col("YD"), F.col("MD"), F.col("DD")
    record = F.col("DATEREC")
    past_year = F.when(month < F.month(record), F.year(record)).otherwise(F.year(record) - 1)
    # A day needs its month; a year stands alone as its first day.
    usable = month.isNotNull() | (year.isNotNull() & day.isNull())
    exact = F.when(usable, date_from_parts(
        F.coalesce(year, past_year), F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1))))
    back = F.lit(None).cast("int")
    for phrase, days in POINT_IN_TIME_DAYS.items():
        back = F.when(F.col("PinT") == phrase, days).otherwise(back)
    no_parts = year.isNull() & month.isNull() & day.isNull()
    return df.withColumns({"EventDate": exact,
                           "EventDate2": F.when(no_parts, F.date_sub(record, back))})


def days_diff(df, variant="expanded"):
    """`DaysDiff`: days from the event to the record, by the first rule that applies.

    A rule that applies but has no date leaves NULL.
    """
    expanded = _check(variant)
    record, phrase = F.col("DATEREC"), F.col("PinT")
    visit = F.col("PrevRecDate" if expanded else "PrevRecCUI")
    days = (F.when(F.col("EventDate").isNotNull(), F.date_diff(record, F.col("EventDate")))
            .when((phrase == "LastClinic") & visit.isNotNull(), F.date_diff(record, visit))
            .when(phrase.isin(*POINT_IN_TIME_DAYS), F.date_diff(record, F.col("EventDate2"))))
    if expanded:
        days = (days.when(phrase == "This_Year", F.date_diff(record, F.col("DATEREC_Year")))
                .when(F.col("FreqChange") == "Same",
                      F.date_diff(record, F.col("PrevRecCUI"))))
    return df.withColumn("DaysDiff", days)


def record_year(df):
    """`DATEREC_Year`: first day of the record's year."""
    return df.withColumn("DATEREC_Year", F.trunc("DATEREC", "year"))


def since_rate(df, variant="expanded", max_gap=HALF_YEAR):
    """`DailyRate2` over the days since the event, and `DailyRateF`: stated, else this."""
    rate = safe_divide("NumS", "DaysDiff")
    if _check(variant):
        phrase = F.col("PinT")
        rate = F.when(F.col("Sin_Dur").isNotNull() | (phrase != "LastClinic")
                      | ((phrase == "LastClinic") & (F.col("DaysDiff") < max_gap)), rate)
    return df.withColumns({"DailyRate2": rate,
                           "DailyRateF": F.coalesce(F.col("DailyRate"), rate)})


def seizure_free_days(df):
    """`SeizureFree`: days covered by a count of zero."""
    days = F.when(F.col("Days").isNotNull(), F.col("TotalTPDays")).otherwise(F.col("DaysDiff"))
    return df.withColumn("SeizureFree", F.when(F.col("NumS") == 0, days))


def carry_forward_same(df, variant="expanded", gap=None):
    """`PrevRateCUI_Same6m`: the earlier rate, where the report says "same".

    Expanded carries over less than half a year, basic over more, as each was
    written.
    """
    if _check(variant):
        near = F.col("DaysDiff") < (HALF_YEAR if gap is None else gap)
    else:
        near = (F.date_diff("DATEREC", "PrevRecCUI") > (HALF_YEAR - 1 if gap is None else gap))
    same = (F.col("FreqChange") == "Same") & near
    return df.withColumn("PrevRateCUI_Same6m", F.when(same, F.col("PrevCUIFreq")))


def final_rate(df):
    """`DailyRateSF`: stated or since rate, else the carried one."""
    return df.withColumn("DailyRateSF", F.coalesce("DailyRateF", "PrevRateCUI_Same6m"))


def severity(df, free_below=FREE_DAYS_BELOW, rate_above=RATE_ABOVE):
    """`FreqSeverity` 1 to 7; a seizure-free time is scored before any rate."""
    free, rate = F.col("SeizureFree"), F.col("DailyRateSF")
    score = F.when(F.lit(False), 0)
    for days, value in free_below:
        score = score.when(free < days, value)
    score = score.when(free.isNotNull(), FREE_DAYS_LONGEST)
    for limit, value in rate_above:
        score = score.when(rate > limit, value)
    lowest, value = RATE_LOWEST
    return df.withColumn("FreqSeverity", score.when(rate < lowest, value))


# --- looking back ------------------------------------------------------------------------

def _prev_record_date(df, near):
    before = near.at("DATEREC", -1)
    usable = (F.col(LANE) == 0) & F.col(PERSON).isNotNull()
    return df.withColumn("PrevRecDate", F.when(usable & (F.col("DATEREC") > before), before))


def _steps_back(df, near, depth=DEPTH):
    """`_steps`: how many rows back the same code stands with an earlier date."""
    steps = range(1, depth + 1)
    rows = df.withColumns({f"_{c}{k}": near.at(c, -k) for k in steps for c in ("CUI", "DATEREC")})
    found = F.lit(None).cast("int")
    for k in reversed(steps):
        same = (F.col("CUI") == F.col(f"_CUI{k}")) & (F.col("DATEREC") > F.col(f"_DATEREC{k}"))
        found = F.when(same, k).otherwise(found)
    usable = (F.col(LANE) == 0) & F.col(PERSON).isNotNull()
    return rows.withColumn("_steps", F.when(usable, found)).drop(
        *[f"_{c}{k}" for k in steps for c in ("CUI", "DATEREC")])


def _value_back(df, near, value, out, depth=DEPTH, only_if_null=None):
    """The value `_steps` rows back, NULL or not."""
    steps = F.col("_steps")
    if only_if_null is not None:
        steps = F.when(F.col(only_if_null).isNull(), steps)
    found = F.when(steps == 1, near.at(value, -1))
    for k in range(2, depth + 1):
        found = found.when(steps == k, near.at(value, -k))
    return df.withColumn(out, found)


def prev_record_date(df, distinct_dates=False, hot_rows=None, hot=None):
    """`PrevRecDate`: date of the person's row before, if earlier.

    Of several rows on one date only the first sees the date before, unless
    `distinct_dates` is set.
    """
    if distinct_dates:
        # Every row of a date gets the same answer, so it is found per date.
        dates = _prev_record_date(*_history(df.select(PERSON, "DATEREC").distinct()))
        dates = dates.drop(LANE)
        return join_null_safe(df, dates, [PERSON, "DATEREC"], "left", hot_rows)
    return _prev_record_date(*_history(df, hot_rows, hot)).drop(LANE)


def prev_same_code(df, value, out, depth=DEPTH, only_if_null=None, hot_rows=None, hot=None):
    """`value` of the nearest of `depth` rows back with the same code and an earlier date.

    The nearest such row decides, even where its value is NULL.
    """
    if depth > DEPTH:
        raise ValueError(f"depth is at most {DEPTH}")
    rows, near = _history(df, hot_rows, hot)
    rows = _value_back(_steps_back(rows, near, depth), near, value, out, depth, only_if_null)
    return rows.drop("_steps", LANE)


# --- put together --------------------------------------------------------------------------

def _row_rules(df, variant):
    rows = record_year(event_date(df))
    return stated_rate(period_days(period_count(event_count(rows, variant))), variant)


def _dated_rates(rows, near, variant):
    """Look-backs for dates, and the rates that follow from them."""
    if _check(variant):
        rows = _prev_record_date(rows, near)
    rows = _value_back(_steps_back(rows, near), near, "DATEREC", "PrevRecCUI")
    return seizure_free_days(since_rate(days_diff(rows, variant), variant))


def _carried_rates(rows, near, variant):
    """The look-back for rates, and what is left to do after it."""
    rows = _value_back(rows, near, "DailyRateF", "PrevCUIFreq", only_if_null="DailyRateF")
    return severity(final_rate(carry_forward_same(rows, variant))).drop("_steps", LANE)


def frequency_table(df, variant="expanded", hot_rows=None, hot=None, path=None):
    """All columns from report to severity. One shuffle and one sort serve every look-back.

    A person's rows meet in one task. `hot` names people too common for that, as from
    `hot_keys` on a base table. With `path`, a new folder, no list is needed: the reports
    are kept there in order, in ranges that cut any person, and looked back over
    across the ranges' ends. Results are the same.
    """
    rows = _row_rules(df, variant)
    if path is None:
        rows, near = _history(rows, hot_rows, hot)
        return _carried_rates(_dated_rates(rows, near, variant), near, variant)
    order = [PERSON, *[c for c in ORDER if c in rows.columns]]
    rows = ranged(rows, order, path).withColumn(LANE, F.lit(0))
    # A rate looked back for follows from rows up to DEPTH further back.
    known = ends(rows, 2 * DEPTH)
    beside = InWindow(Window.partitionBy(PERSON).orderBy(PART, AT))
    known = _dated_rates(known, beside, variant)
    rows = with_halos(rows, known, [PERSON, "DATEREC", "CUI", "DailyRateF"], back=DEPTH)
    near = AcrossRanges([PERSON])
    return without_halos(_carried_rates(_dated_rates(rows, near, variant), near, variant))


WORKING = ("PrevRecCUI", "PrevRecDate", "NumS", "NTP", "DailyRate", "DailyRate2", "DailyRateF",
           "PrevCUIFreq", "PrevRateCUI_Same6m")


def severity_table(df, variant="expanded", hot_rows=None, hot=None, path=None):
    """The reports with event dates, days, final rate and severity."""
    table = frequency_table(df, variant, hot_rows, hot, path).drop(*WORKING)
    if variant == "basic":
        table = table.drop("TotalTPDays", "DATEREC_Year")
    return table


def severity_by_code(df, keys=("SYSTEM_ID", "DATEREC", "LETTER", "CUI")):
    """Keys and severity of the scored rows."""
    return df.select(*keys, "FreqSeverity").filter(F.col("FreqSeverity").isNotNull())


def severity_grouped(df, groups):
    """Scores with the seizure group of their code, without repeats."""
    known = (groups.filter(F.col("Grouping").isNotNull())
             .select("CUI", F.col("Grouping").alias("Seizures")))
    return lookup_join(df, known, "CUI", "inner").distinct()


def rate_subsets(df):
    """(seizure-free rows, rows with a rate above zero)."""
    return df.filter(F.col("SeizureFree").isNotNull()), df.filter(F.col("DailyRateSF") > 0)


def max_severity(df, keys=("DATEREC",), hot_rows=None):
    """Rows whose severity is the largest of their group, ties included."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    df = df.filter(F.col("FreqSeverity").isNotNull())
    # One aggregate gives the maximum and which groups are too large for a task.
    top = df.groupBy(*keys).agg(F.max("FreqSeverity").alias("_top"), F.count("*").alias("_rows"))
    hot = None if hot_rows is None else hot_keys(top, keys, hot_rows, "_rows")
    return join_null_safe(df, top.drop("_rows"), keys, "left_semi", hot_rows, hot=hot,
                          also=F.col("FreqSeverity") == F.col("_top"))


def score_ends(col="FreqSeverity"):
    """Smallest and largest of `col`, as columns to observe while a table is written."""
    return [F.min(col).alias("low"), F.max(col).alias("high")]


def min_max_norm(df, col="FreqSeverity", out="NV", ends=None):
    """`col` scaled to 0..1 over the whole table; NULL where all values are equal.

    `ends` are the smallest and largest value, as observed while the table was written;
    without them the table is evaluated once more.
    """
    if ends is None:
        found = df.agg(F.struct(*score_ends(col))).scalar()
        low, high = found["low"], found["high"]
    else:
        kind = dict(df.dtypes)[col]
        low, high = (F.lit(x).cast(kind) for x in ends)
    return df.withColumn(out, safe_divide(F.col(col) - low, high - low))


def person_timeline(doses, grouped, person=None, unique=False, ends=None):
    """Dose ratios and normalised severities as one long table.

    Severities are scaled over all people, whoever is asked for. `unique` says that
    dose ratios hold no repeated rows, as those of `dose_ratio` on largest doses. `ends`
    are those of all severities, if known.

    A natural full join on all six columns: a key names at most one severity, so one
    aggregate over both tables puts the two together.
    """
    keys = ["SYSTEM_ID", "LETTER", "DATEREC", "CUI", "Category", "NV"]
    scaled = min_max_norm(grouped, ends=ends).withColumnRenamed("Seizures", "Category")
    if person is not None:
        doses = doses.filter(F.col("SYSTEM_ID") == person)
        scaled = scaled.filter(F.col("SYSTEM_ID") == person)
    series = doses if unique else doses.distinct()
    series = series.withColumnsRenamed({"PREF": "Category", "DailyRate": "NV"})
    score = dict(grouped.dtypes)["FreqSeverity"]
    both = series.select(*keys, F.lit(None).cast(score).alias("FreqSeverity"), F.lit(1).alias("_n")).unionByName(
        scaled.select(*keys, "FreqSeverity", F.lit(0).alias("_n")))
    joined = both.groupBy(*keys).agg(F.max("FreqSeverity").alias("FreqSeverity"), F.sum("_n").alias("_n"))
    times = F.array_repeat(F.lit(0), F.greatest(F.col("_n"), F.lit(1)).cast("int"))
    return joined.withColumn("_time", F.explode(times)).select(*keys, "FreqSeverity")
