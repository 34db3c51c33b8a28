"""From seizure reports and letter dates to grouped severities."""

from letterflow.operators.dates import attach_record_date, record_date
from letterflow.operators.frequency import (
    min_max_norm, person_timeline, score_ends, severity_by_code, severity_grouped, severity_table)
from letterflow.sources.schemas import TABLE_SCHEMAS
from letterflow.sources.sink import keep, keep_observed

# The columns of a report after person and letter.
ANNOTATION = tuple(TABLE_SCHEMAS["seizure_frequency"].names[2:])


def dated_reports(annotations, dates, by="LETTER", **options):
    """Seizure reports with record date, by LETTER or by the letter list's DOC."""
    if "Letter" in annotations.columns:
        annotations = annotations.withColumnRenamed("Letter", "LETTER")
    kept = ["DATEREC"] if by == "LETTER" else ["DATEREC", by]
    dated = attach_record_date(annotations, record_date(dates), keep=kept, **options)
    return dated.select("SYSTEM_ID", "DATEREC", by, *ANNOTATION)


def scored_reports(reports, variant="expanded", path=None, ranges=None, **options):
    """Severities per person, date, letter and code.

    Grouping, maxima and scaling each read the scores more than once. With `path`
    they are kept there: five narrow columns, against a shuffle of the full reports. With
    `ranges`, another new folder, a person of any number of reports is cut into ranges.
    """
    scores = severity_by_code(severity_table(reports, variant, path=ranges, **options))
    return scores if path is None else keep(scores, path)


def grouped_severity(reports, groups, variant="expanded", path=None, **options):
    """Distinct severities per person, date, letter, code and seizure group."""
    return severity_grouped(scored_reports(reports, variant, path, **options), groups)


def kept_severity(reports, groups, path, variant="expanded", **options):
    """`grouped_severity`, kept in the new folder `path`, and its smallest and largest value.

    Both are seen while the table is written, so nothing is evaluated for them.
    """
    grouped = severity_grouped(severity_by_code(severity_table(reports, variant, **options)), groups)
    kept, ends = keep_observed(grouped, path, *score_ends())
    return kept, (ends["low"], ends["high"])


def normalised_severity(reports, groups, path, variant="expanded", **options):
    """Grouped severities scaled to 0..1; the kept table is read once."""
    kept, ends = kept_severity(reports, groups, path, variant, **options)
    return min_max_norm(kept, ends=ends)


def timeline(doses, reports, groups, path, variant="expanded", **options):
    """Dose ratios (no repeated rows) and scaled severities as one long table."""
    kept, ends = kept_severity(reports, groups, path, variant, **options)
    return person_timeline(doses, kept, unique=True, ends=ends)
