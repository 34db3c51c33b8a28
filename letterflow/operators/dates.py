"""Record dates: the clinic date of a letter, or its letter date."""

from pyspark.sql import functions as F

from letterflow.functions.scalars import (
    date_from_parts, expand_birth_year, expand_visit_year, first_not_null, normalise_id,
    parse_dmy)
from letterflow.operators.joins import factored_join, join_null_safe
from letterflow.sources.schemas import BIRTH_DAY_MONTH, DATES

PARTS = tuple(name for name, _ in BIRTH_DAY_MONTH + DATES)
EVENT_PARTS = ("YD", "MD", "DD")


def record_date(df, clinic="Clinic_Date", letter="LetDate", out="DATEREC"):
    """Clinic date, else letter date, as a date; text is read day first."""
    chosen = first_not_null(clinic, letter)
    if dict(df.dtypes)[clinic] == "string":
        chosen = parse_dmy(chosen)
    return df.withColumn(out, chosen)


def normalise_annotations(df, keep=(), birth_pivot=None, visit_pivot=None):
    """Dates from their parts, record date and clean identifiers, for any kind.

    The parts are dropped, the event parts YD, MD, DD too unless named in `keep`.
    """
    expand = {"DoB": (expand_birth_year, birth_pivot), "Clinic": (expand_visit_year, visit_pivot),
              "Let": (expand_visit_year, visit_pivot)}
    dates = {"DoB": "DoB", "Clinic": "Clinic_Date", "Let": "Let_Date"}
    years, built = {}, {}
    for prefix, (rule, pivot) in expand.items():
        if {f"{prefix}{p}" for p in EVENT_PARTS} <= set(df.columns):
            years[f"_{prefix}Y"] = rule(f"{prefix}YD", pivot)
            built[dates[prefix]] = date_from_parts(
                f"_{prefix}Y", f"{prefix}MD", f"{prefix}DD")
        else:
            built[dates[prefix]] = F.lit(None).cast("date")
    clean = {"NHS_No": normalise_id("NHS_No"), "Hosp_No": normalise_id("Hosp_No", " ")}
    dropped = {*PARTS, *EVENT_PARTS} - set(keep)
    return (df.withColumns(years).withColumns({**clean, **built})
            .withColumn("DATEREC", F.coalesce("Clinic_Date", "Let_Date"))
            .drop(*dropped, *years))


def letter_dates(dates, letters, on="LETTER", hot_rows=None, hot=None, right_hot=None):
    """Dates with the letter list's DOC; the list's own person id is left out."""
    return join_null_safe(dates, letters.drop("SYSTEM_ID"), on, "left", hot_rows, hot=hot,
                          right_hot_rows=hot_rows, right_hot=right_hot)


def attach_record_date(df, dates, on="LETTER", keep=("DATEREC",), hot_rows=None, hot=None,
                       right_hot=None):
    """Annotations with the record date of their letter (and what else `keep` names)."""
    return join_null_safe(df, dates.select(on, *keep), on, "left", hot_rows, hot=hot,
                          right_hot_rows=hot_rows, right_hot=right_hot)


def attach_record_date_factored(df, dates, on="LETTER", keep=("DATEREC",), hot=None, right_hot=None):
    """`attach_record_date` without multiplying annotations of no letter by dates of no letter."""
    return factored_join(df, dates.select(on, *keep), on, hot, right_hot)


def letters_without_date(letters, dates, on="DOC", hot_rows=None):
    """Listed letters that have no row in the date table."""
    return join_null_safe(letters, dates.select(on).distinct(), on, "left_anti", hot_rows)


def distinct_letters(dates, on="LETTER"):
    return dates.select(on).distinct()
