"""Column functions. Bad input gives NULL, never an error under ANSI mode."""

from pyspark.sql import functions as F


def col(c):
    return F.col(c) if isinstance(c, str) else c


def to_number(c):
    """Text to double; text that is no number gives NULL."""
    text = col(c).cast("string")
    # A trailing type letter ("5d", "2.5f") is a number to the JVM but not here.
    return F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))


def parse_dmy(c):
    """Day-first text such as 03/11/2015 or 3/11/2015 to a date."""
    return F.try_to_date(F.trim(col(c)), "d/M/yyyy")


def date_from_parts(year, month, day):
    """Year (0 to 9999), month and day to a date; a missing or impossible part gives NULL."""
    y, dash = col(year), F.lit("-")
    text = F.concat(F.lpad(y.cast("string"), 4, "0"), dash, col(month), dash, col(day))
    return F.when(y <= 9999, text.try_cast("date"))


def expand_birth_year(c, pivot=None):
    """Two-digit birth years are 19xx; with a pivot, years below it are 20xx."""
    y = col(c)
    full = F.when(y > 1000, y)
    if pivot is not None:
        full = full.when(y < pivot, y + 2000)
    return full.when(y < 100, y + 1900)


def expand_visit_year(c, pivot=None):
    """Two-digit clinic and letter years: below 25 is 20xx, above is 19xx.

    25 itself has no rule and gives NULL. With a pivot given, years up to and
    including it are 20xx and all later ones 19xx.
    """
    y = col(c)
    full = F.when(y > 1000, y)
    if pivot is None:
        return full.when(y < 25, y + 2000).when(y > 25, y + 1900)
    return full.when(y <= pivot, y + 2000).when(y > pivot, y + 1900)


def normalise_id(c, strip=" -"):
    """Remove blanks and hyphens from an identifier."""
    return F.translate(col(c), strip, "")


def gender_code(c):
    """male 1, female 2, unknown 9, anything else NULL."""
    g = col(c)
    return F.when(g == "male", 1).when(g == "female", 2).when(g.isNull(), 9)


def round2(c):
    """Two decimals, ties to the even digit."""
    return F.bround(col(c), 2)


def safe_divide(num, den):
    """num / den, with x/0 infinite in the direction of x, and 0/0 NULL."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return (F.when(d == 0, F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf"))))
            .otherwise(n / d))


def first_not_null(*cols):
    return F.coalesce(*[col(c) for c in cols])
