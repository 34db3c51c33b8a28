"""From prescription annotations and letter dates to dose ratios."""

from letterflow.operators.dates import attach_record_date, record_date
from letterflow.operators.dose import (
    CLEAN_KEYS, dose_ratio, generic_name, max_daily_dose, total_daily_dose)
from letterflow.sources.scan import upper_names
from letterflow.sources.schemas import TABLE_SCHEMAS

# The columns of a prescription after person and letter.
ANNOTATION = tuple(name.upper() for name in TABLE_SCHEMAS["prescriptions"].names[2:])


def dated_prescriptions(annotations, dates, by="LETTER", **options):
    """Prescriptions with record date, by LETTER or by the letter list's DOC."""
    kept = ["DATEREC"] if by == "LETTER" else ["DATEREC", by]
    dated = attach_record_date(upper_names(annotations), record_date(dates), keep=kept, **options)
    return dated.select("SYSTEM_ID", "DATEREC", by, *ANNOTATION)


def daily_doses(prescriptions, name_map=None, keys=CLEAN_KEYS, **options):
    """Largest total daily dose per person, letter, date, code and generic name."""
    return max_daily_dose(generic_name(total_daily_dose(prescriptions, **options), name_map), keys)


def dose_ratios(prescriptions, top_doses, name_map=None, **options):
    """Daily doses as a share of each medicine's top dose."""
    return dose_ratio(daily_doses(prescriptions, name_map, **options), top_doses)
