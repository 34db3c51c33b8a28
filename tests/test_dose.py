"""One row per rule of the split-dose and daily-dose logic."""

import pytest

from conftest import rows_of
from letterflow.functions.lookups import generic_names
from letterflow.operators import dose
from letterflow.plans.prescriptions import daily_doses, dated_prescriptions, dose_ratios

PRESC = ("SYSTEM_ID int, LETTER string, START int, `END` int, CUI string, NAME string, "
         "DOSE double, UNIT string, FREQUENCY double")


def row(letter, start, end, cui="C1", dose=100.0, unit="mg", freq=1.0, name="n"):
    return (1, letter, start, end, cui, name, dose, unit, freq)


def result(df, *columns):
    return {(r.LETTER, r.END): tuple(r[c] for c in columns) for r in df.collect()}


ROWS = [
    row("single", 1, 1), row("single", 2, 2, freq=2.0), row("single", 3, 3, unit="g", dose=0.5),
    row("single", 4, 4, unit="ml"), row("single", 5, 5, freq=0.5),
    row("pair", 1, 1, dose=200.0), row("pair", 1, 2, dose=300.0), row("pair", 9, 3),
    row("three", 1, 1, dose=1.0), row("three", 1, 2, dose=2.0), row("three", 1, 3, dose=4.0),
    row("four", 1, 1, dose=1.0), row("four", 1, 2, dose=2.0), row("four", 1, 3, dose=4.0),
    row("four", 1, 4, dose=8.0),
    row("two drugs", 1, 1, "C1", 1.0), row("two drugs", 1, 2, "C1", 2.0),
    row("two drugs", 1, 3, "C2", 4.0), row("two drugs", 1, 4, "C2", 8.0),
    row("unit", 1, 1, unit="ml"), row("unit", 1, 2),
    row("freq", 1, 1, "C0055891", freq=None), row("freq", 2, 2, "C9", freq=None),
    row("mixed", 1, 1, freq=2.0), row("mixed", 1, 2, freq=1.0),
    row("no start", None, 1), row("no start", None, 2, freq=3.0),
    row(None, 1, 1), row(None, 1, 2),
]


def test_daily_dose_rules(frame):
    got = result(dose.total_daily_dose(frame(PRESC, ROWS)), "AnotherDose", "Q2ndDose",
                 "Q3rdDose", "DailyDose")
    none = (None, None, None)
    assert got["single", 1] == (*none, 100.0)
    assert got["single", 2] == (*none, 200.0)
    assert got["single", 3] == (*none, 500.0)
    assert got["single", 4] == (*none, None)
    assert got["single", 5] == (*none, None)
    # The first part of a split dose has no dose of its own.
    assert got["pair", 1] == (*none, None)
    assert got["pair", 2] == ("2nd", 200.0, None, 500.0)
    assert got["pair", 3] == (*none, 100.0)
    assert got["three", 2] == ("2nd", 1.0, 4.0, 7.0)
    assert got["three", 3] == ("3rd", None, None, None)
    # A fourth part is seen as another third and not added.
    assert got["four", 2] == ("2nd", 1.0, 4.0, 7.0)
    assert got["four", 4] == ("3rd", None, None, None)
    # Of two medicines in one span only the first one's pair is found.
    assert got["two drugs", 2] == ("2nd", 1.0, None, 3.0)
    assert got["two drugs", 3] == (*none, None)
    assert got["two drugs", 4] == (*none, 8.0)
    # A part without a quantity makes the sum unknown.
    assert got["unit", 2] == ("2nd", None, None, None)
    assert got["freq", 1] == (*none, 100.0)
    assert got["freq", 2] == (*none, None)
    assert got["mixed", 1] == (*none, 200.0)
    assert got["mixed", 2] == (*none, 100.0)
    assert got["no start", 1] == (*none, None)
    assert got["no start", 2] == (*none, 300.0)
    # Rows of no known letter are not neighbours.
    assert got[None, 1] == got[None, 2] == (*none, 100.0)


def test_steps_alone_equal_the_whole(frame):
    df = frame(PRESC, ROWS)
    steps = dose.daily_dose(dose.split_dose_qty(dose.split_dose_flag(dose.quantity_mg(df))))
    whole = dose.total_daily_dose(df)
    assert rows_of(steps.select(whole.columns)) == rows_of(whole)


def test_interleaved_spans_with_another_order(frame):
    rows = [row("L", 5, 1, dose=1.0), row("L", 9, 2, dose=2.0), row("L", 5, 3, dose=4.0)]
    df = frame(PRESC, rows)
    got = result(dose.total_daily_dose(df, order=("END",)), "AnotherDose", "Q2ndDose", "DailyDose")
    assert got["L", 3] == ("2nd", 1.0, 5.0)
    previous = dose.total_daily_dose(df, "previous", order=("END",))
    assert result(previous, "Q2ndDose")["L", 3] == (2.0,)


def test_unknown_rule(frame):
    with pytest.raises(ValueError):
        dose.total_daily_dose(frame(PRESC, ROWS), "other")


def test_generic_names(frame):
    df = frame("i int, NAME string, CUI string", [
        (0, "Epilim Chrono", "C0377265"), (1, "x", "C0377265"), (2, None, "C0006949"),
        (3, "Perampanel", "C0893761"), (4, "x", "y"), (5, "Topiramate", None)])

    def names(version):
        named = dose.generic_name(df, generic_names(version))
        return [r.PREF for r in named.orderBy("i").collect()]

    assert names(None) == ["Sodium Valproate", "Levetiracetam", "Carbamazepine", "Perampanel",
                           None, "Topiramate"]
    assert names(1)[2:4] == ["Carbamazepine", "Lacosamide"]
    assert names(2)[2:4] == [None, "Perampanel"]
    assert len({e[1:] for e in generic_names()}) == len(generic_names())


def test_generic_names_from_a_table(spark, frame):
    table = spark.sql("""SELECT * FROM VALUES ('NAME', 'a', 2, 'late'), ('NAME', 'a', 1, 'early'),
        ('CUI', 'c', 0, 'code') AS t(match_col, value, priority, generic)""")
    df = frame("NAME string, CUI string", [("a", "z"), ("a", "c"), (None, None)])
    assert rows_of(dose.generic_name(df, table), "PREF") == [("code",), ("early",), (None,)]


def test_clean_max_and_argmax(frame):
    df = frame("SYSTEM_ID int, DATEREC date, DOC int, CUI string, NAME string, DailyDose double", [
        (1, None, 1, "C", "a", 5.0)] + [(1, __import__("datetime").date(2015, 1, 1), 1, "C", n, d)
                                        for n, d in [("b", 5.0), ("a", 5.0), ("a", 5.0),
                                                     ("c", 2.0), ("d", None)]])
    keys = dose.CLEAN_KEYS_BY_NAME
    clean = dose.daily_dose_clean(df, keys)
    assert clean.count() == 3
    best = rows_of(dose.max_dose_row(df), "NAME", "DailyDose")
    assert best == [("a", 5.0)]
    highest = dose.max_daily_dose(df, ("SYSTEM_ID", "CUI"))
    assert rows_of(highest) == rows_of(dose.max_daily_dose(clean, ("SYSTEM_ID", "CUI")))
    assert rows_of(dose.rows_per(clean, "NAME")) == [("a", 1), ("b", 1), ("c", 1)]


def test_from_annotations_to_ratios(spark, frame):
    annotations = frame("SYSTEM_ID int, Letter string, Start int, End int, CUI string, "
                        "Name string, Dose double, Unit string, Frequency double", [
                            (1, "L1", 1, 2, "C0377265", "Keppra", 250.0, "mg", 2.0),
                            (1, "L1", 8, 9, "C0064636", "x", 50.0, "mg", 1.0),
                            (1, "L2", 1, 2, "C0377265", "Keppra", 250.0, "mg", 2.0)])
    dates = frame("SYSTEM_ID int, LETTER string, DOC int, Clinic_Date string, LetDate string",
                  [(1, "L1", 1, None, "3/4/2015")])
    dated = dated_prescriptions(annotations, dates)
    assert dated.columns[:3] == ["SYSTEM_ID", "DATEREC", "LETTER"]
    top = spark.sql("SELECT * FROM VALUES ('Levetiracetam', 3000.0D) AS t(ASM, Dose)")
    got = rows_of(dose_ratios(dated, top), "LETTER", "PREF", "DailyDose", "TopDose", "DailyRate")
    # The letter without a date drops out; a medicine without a top dose has no ratio.
    assert got == [("L1", "Lamotrigine", 50.0, None, None),
                   ("L1", "Levetiracetam", 500.0, 3000.0, 0.17)]
    assert daily_doses(dated).columns == [*dose.CLEAN_KEYS, "DailyDose"]
