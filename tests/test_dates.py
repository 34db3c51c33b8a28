from datetime import date

import pytest

from conftest import rows_of
from letterflow.operators import dates

DATES = [("a", "1/2/2015", "3/2/2015"), ("b", None, "3/2/2015"), ("c", "40/2/2015", "3/2/2015"),
         ("d", None, None)]


def test_record_date_from_text_and_dates(frame):
    df = frame("LETTER string, Clinic_Date string, LetDate string", DATES)
    got = dates.record_date(df)
    # The date is chosen first and read afterwards, so a bad clinic date stays unknown.
    assert rows_of(got, "LETTER", "DATEREC") == [
        ("a", date(2015, 2, 1)), ("b", date(2015, 2, 3)), ("c", None), ("d", None)]
    typed = frame("x date, y date", [(None, date(2015, 1, 1))])
    assert rows_of(dates.record_date(typed, "x", "y", "z"), "z") == [(date(2015, 1, 1),)]


@pytest.mark.parametrize("hot_rows", [None, 0])
def test_letters_and_dates(frame, hot_rows):
    table = dates.record_date(frame(
        "SYSTEM_ID int, LETTER string, Clinic_Date string, LetDate string",
        [(1, *r) for r in DATES]))
    letters = frame("SYSTEM_ID int, LETTER string, DOC int", [(9, "a", 1), (9, "z", 2), (9, None, 3)])
    linked = dates.letter_dates(table, letters, hot_rows=hot_rows)
    assert rows_of(linked, "SYSTEM_ID", "LETTER", "DOC")[0] == (1, "a", 1)
    assert linked.count() == 4
    assert rows_of(dates.letters_without_date(letters, linked, "DOC", hot_rows), "DOC") == [(2,), (3,)]
    assert rows_of(dates.letters_without_date(letters, table, "LETTER", hot_rows), "DOC") == [
        (2,), (3,)]
    annotations = frame("LETTER string, START int", [("a", 1), ("a", 2), ("q", 3), (None, 4)])
    got = dates.attach_record_date(annotations, linked, hot_rows=hot_rows)
    assert got.columns == ["LETTER", "START", "DATEREC"]
    assert rows_of(got, "START", "DATEREC") == [
        (1, date(2015, 2, 1)), (2, date(2015, 2, 1)), (3, None), (4, None)]
    assert dates.distinct_letters(annotations).count() == 3


def test_one_date_is_enough_for_a_document(frame):
    table = frame("LETTER int, Clinic_Date string, LetDate string",
                  [(1, "01/02/2015", None), (3, None, "05/06/2016"), (5, "01/01/2010", "02/01/2010")])
    letters = frame("LETTER int, DOC int", [(1, 10), (2, 10), (3, 11), (4, 12), (5, 13), (6, 14)])
    linked = dates.letter_dates(table, letters)
    assert rows_of(dates.letters_without_date(letters, linked, "DOC")) == [(4, 12), (6, 14)]
