"""One row per rule, worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from letterflow.operators import frequency as fq
from letterflow.plans.frequency import dated_reports

SF = {"SYSTEM_ID": "string", "LETTER": "int", "DATEREC": "date", "CUI": "string",
      "FreqChange": "string", "NofS": "double", "UNofS": "double", "TP": "string",
      "NofTP": "double", "LNofTP": "double", "Sin_Dur": "string", "YD": "int", "MD": "int",
      "DD": "int", "PinT": "string"}


@pytest.fixture
def reports(spark):
    def make(rows, **extra):
        names = {**SF, **extra}
        full = [tuple({"SYSTEM_ID": "p", "LETTER": i, **r}.get(n) for n in names)
                for i, r in enumerate(rows)]
        schema = ", ".join(f"{n} {t}" for n, t in names.items())
        return spark.createDataFrame(full, schema).repartition(3)
    return make


def column(df, *names):
    rows = df.orderBy("LETTER").select(*names).collect()
    return [r[0] if len(names) == 1 else tuple(r) for r in rows]


def test_event_count(reports):
    rows = [dict(NofS=3.0), dict(UNofS=2.0), dict(UNofS=0.0), dict(NofS=0.0, UNofS=5.0),
            dict(NofS=3.0, Sin_Dur="Since"), dict(NofS=3.0, Sin_Dur="During", TP="Month"),
            dict(UNofS=2.0, Sin_Dur="During"), dict(NofS=10.0, Sin_Dur="During", TP="Week", MD=3),
            dict(UNofS=10.0, Sin_Dur="During", TP="Week", MD=3),
            dict(NofS=10.0, Sin_Dur="During", TP="Week"), dict(NofS=1.0, Sin_Dur="other")]
    assert column(fq.event_count(reports(rows)), "NumS") == [
        3.0, 2.0, None, 0.0, 3.0, 3.0, 2.0, 43.0, 43.0, None, None]
    assert column(fq.event_count(reports(rows), "basic"), "NumS") == [
        3.0, 2.0, None, 0.0, 3.0, 3.0, 2.0, 10.0, 10.0, 10.0, 1.0]
    with pytest.raises(ValueError):
        fq.event_count(reports(rows), "third")


def test_periods_and_stated_rate(reports):
    rows = [dict(NofS=6.0, TP="Day", NofTP=2.0), dict(NofS=7.0, TP="Week", LNofTP=2.0),
            dict(NofS=1.0, TP="Month", NofTP=0.0, LNofTP=2.0), dict(NofS=1.0, TP="Year", NofTP=1.0),
            dict(NofS=1.0, NofTP=1.0), dict(NofS=3.0, TP="Day", NofTP=1.0, Sin_Dur="Since")]
    df = fq.period_days(fq.period_count(fq.event_count(reports(rows))))
    assert column(df, "NTP", "Days", "TotalTPDays") == [
        (2.0, 1, 2.0), (2.0, 7, 14.0), (None, 30, None), (1.0, 365, 365.0), (1.0, None, None),
        (1.0, 1, 1.0)]
    assert column(fq.stated_rate(df), "DailyRate") == [3.0, 0.5, None, 1 / 365, None, None]
    assert column(fq.stated_rate(df, "basic"), "DailyRate") == [3.0, 0.5, None, 1 / 365, None, 3.0]


def test_event_date(reports):
    day = date(2015, 6, 20)
    rows = [dict(YD=2014, MD=3, DD=9), dict(YD=2014, MD=3), dict(YD=2014), dict(YD=2014, DD=9),
            dict(MD=3), dict(MD=6), dict(MD=8, DD=5), dict(DD=5), dict(YD=2014, MD=2, DD=30),
            dict(YD=15, MD=1), dict(PinT="Last_Month"), dict(PinT="Last_Year"),
            dict(PinT="Last_Year", DD=1), dict(PinT="LastClinic")]
    df = fq.event_date(reports([dict(DATEREC=day, **r) for r in rows] + [dict(MD=3)]))
    assert column(df, "EventDate") == [
        date(2014, 3, 9), date(2014, 3, 1), date(2014, 1, 1), None, date(2015, 3, 1),
        date(2014, 6, 1), date(2014, 8, 5), None, None, date(15, 1, 1)] + [None] * 5
    assert column(df, "EventDate2")[9:14] == [None, date(2015, 5, 21), date(2014, 6, 20), None, None]


def test_days_diff_rules(reports):
    day, prev, code = date(2015, 6, 20), date(2015, 6, 10), date(2015, 6, 1)
    extra = dict(EventDate="date", EventDate2="date", PrevRecDate="date", PrevRecCUI="date",
                 DATEREC_Year="date")
    base = dict(DATEREC=day, PrevRecDate=prev, PrevRecCUI=code, DATEREC_Year=date(2015, 1, 1))
    rows = [dict(EventDate=date(2015, 6, 25), PinT="LastClinic"), dict(PinT="LastClinic"),
            dict(PinT="LastClinic", PrevRecDate=None, FreqChange="Same"),
            dict(PinT="Last_Month", EventDate2=date(2015, 5, 21)),
            # The rule applies, so a missing date is not made up for by a later rule.
            dict(PinT="Last_Year", FreqChange="Same"), dict(PinT="This_Year", FreqChange="Same"),
            dict(FreqChange="Same"), dict(FreqChange="Decreased")]
    df = reports([{**base, **r} for r in rows], **extra)
    assert column(fq.days_diff(df), "DaysDiff") == [-5, 10, 19, 30, None, 170, 19, None]
    assert column(fq.days_diff(df, "basic"), "DaysDiff") == [-5, 19, 19, 30, None, None, None, None]


def test_since_rate_and_free_days(reports):
    extra = dict(NumS="double", DaysDiff="int", DailyRate="double", Days="int",
                 TotalTPDays="double")
    rows = [dict(NumS=4.0, DaysDiff=8), dict(NumS=4.0, DaysDiff=8, Sin_Dur="Since"),
            dict(NumS=4.0, DaysDiff=8, PinT="Last_Month"),
            dict(NumS=4.0, DaysDiff=182, PinT="LastClinic"),
            dict(NumS=4.0, DaysDiff=183, PinT="LastClinic"),
            dict(NumS=4.0, DaysDiff=0, Sin_Dur="Since"), dict(NumS=0.0, DaysDiff=0, Sin_Dur="Since"),
            dict(NumS=0.0, DaysDiff=5, Days=7, TotalTPDays=14.0, DailyRate=0.0),
            dict(NumS=0.0, DaysDiff=5, Days=7), dict(NumS=0.0, DaysDiff=5)]
    df = fq.seizure_free_days(fq.since_rate(reports(rows, **extra)))
    assert column(df, "DailyRate2") == [
        None, 0.5, 0.5, 4 / 182, None, float("inf"), None, None, None, None]
    assert column(df, "DailyRateF")[7] == 0.0
    assert column(df, "SeizureFree") == [None] * 6 + [0.0, 14.0, None, 5.0]
    basic = fq.since_rate(reports(rows, **extra), "basic")
    assert column(basic, "DailyRate2")[:5] == [0.5, 0.5, 0.5, 4 / 182, 4 / 183]


def test_previous_record_needs_an_earlier_date(reports):
    d1, d2 = date(2015, 1, 1), date(2015, 2, 1)
    df = reports([dict(DATEREC=d1), dict(DATEREC=d2), dict(DATEREC=d2), dict(),
                  dict(SYSTEM_ID=None, DATEREC=d1), dict(SYSTEM_ID=None, DATEREC=d2)])
    assert column(fq.prev_record_date(df), "PrevRecDate") == [None, d1, None, None, None, None]
    assert column(fq.prev_record_date(df, distinct_dates=True), "PrevRecDate") == [
        None, d1, d1, None, None, None]


def days(*numbers):
    return [date(2015, 1, n) for n in numbers]


def test_same_code_within_six_rows(reports):
    rows = [dict(DATEREC=d, CUI="A" if i in (0, 7) else "B") for i, d in enumerate(days(*range(1, 9)))]
    seven_back = fq.prev_same_code(reports(rows), "DATEREC", "prev")
    assert column(seven_back, "prev")[7] is None
    six_back = fq.prev_same_code(reports(rows[1:7] + [dict(DATEREC=date(2015, 1, 20), CUI="B")]),
                                 "DATEREC", "prev", depth=1)
    assert column(six_back, "prev")[-1] == date(2015, 1, 7)
    near = [dict(DATEREC=d, CUI="A" if i in (0, 6) else "B") for i, d in enumerate(days(*range(1, 8)))]
    assert column(fq.prev_same_code(reports(near), "DATEREC", "prev"), "prev")[6] == date(2015, 1, 1)
    with pytest.raises(ValueError):
        fq.prev_same_code(reports(near), "DATEREC", "prev", depth=7)


def test_same_code_ignores_the_same_date_and_unknown_codes(reports):
    d1, d2 = days(1, 2)
    rows = [dict(DATEREC=d1, CUI="A", NofS=1.0), dict(DATEREC=d2, CUI="A", NofS=None),
            dict(DATEREC=d2, CUI="A", NofS=2.0), dict(DATEREC=d2, CUI=None),
            dict(DATEREC=None, CUI="A", NofS=3.0)]
    df = reports(rows)
    assert column(fq.prev_same_code(df, "DATEREC", "prev"), "prev") == [None, d1, d1, None, None]
    only = fq.prev_same_code(df, "NofS", "prev", only_if_null="NofS")
    assert column(only, "prev") == [None, 1.0, None, None, None]


def test_nearest_row_decides_even_without_a_rate(reports):
    rows = [dict(DATEREC=d, CUI="A", NofS=n) for d, n in zip(days(1, 2, 3), [5.0, None, None])]
    got = fq.prev_same_code(reports(rows), "NofS", "prev", only_if_null="NofS")
    assert column(got, "prev") == [None, 5.0, None]


def test_carried_rate(reports):
    extra = dict(DaysDiff="int", PrevRecCUI="date", PrevCUIFreq="double", DailyRateF="double")
    base = dict(FreqChange="Same", DATEREC=date(2015, 12, 31), PrevCUIFreq=0.5)
    rows = [dict(DaysDiff=182, PrevRecCUI=date(2015, 12, 1)), dict(DaysDiff=183, PrevRecCUI=None),
            dict(DaysDiff=None, PrevRecCUI=date(2015, 1, 1)),
            dict(DaysDiff=1, FreqChange="Decreased"), dict(DaysDiff=1, DailyRateF=2.0)]
    df = reports([{**base, **r} for r in rows], **extra)
    carried = fq.final_rate(fq.carry_forward_same(df))
    assert column(carried, "DailyRateSF") == [0.5, None, None, None, 2.0]
    basic = fq.final_rate(fq.carry_forward_same(df, "basic"))
    assert column(basic, "DailyRateSF") == [None, None, 0.5, None, 2.0]


def test_severity_thresholds(reports):
    free = [(-3.0, 6), (6.0, 6), (7.0, 5), (29.5, 5), (30.0, 4), (181.0, 4), (182.0, 3), (364.0, 3),
            (365.0, 2), (729.5, 2), (730.0, 1)]
    rate = [(float("inf"), 7), (1.5, 7), (1.0, 6), (0.2857143, 5), (0.0657534, 4), (0.0109589, 3),
            (0.0054795, 2), (0.0027322, None), (0.00273215, None), (0.0027321, None), (0.002732, 1),
            (-1.0, 1), (None, None)]
    rows = ([dict(SeizureFree=f, DailyRateSF=9.0) for f, _ in free]
            + [dict(DailyRateSF=r) for r, _ in rate])
    df = fq.severity(reports(rows, SeizureFree="double", DailyRateSF="double"))
    assert column(df, "FreqSeverity") == [s for _, s in free + rate]


def test_columns_and_rows_of_the_severity_table(reports):
    df = reports([dict(DATEREC=date(2015, 1, 1), CUI="A", NofS=2.0, TP="Week", NofTP=1.0)] * 3)
    table = fq.severity_table(df)
    assert set(table.columns) == {
        *SF, "EventDate", "EventDate2", "DATEREC_Year", "Days", "TotalTPDays", "DaysDiff",
        "SeizureFree", "DailyRateSF", "FreqSeverity"}
    assert table.count() == 3
    # 2 / 7 lies just below the printed threshold 0.2857143.
    assert column(table, "FreqSeverity") == [5, 5, 5]


def test_groups_maxima_subsets_and_scaling(spark, reports):
    d = date(2015, 1, 1)
    df = reports([dict(DATEREC=d, CUI="A", FreqSeverity=2), dict(DATEREC=d, CUI="B", FreqSeverity=7),
                  dict(SYSTEM_ID="q", DATEREC=d, CUI="A", FreqSeverity=7), dict(CUI="A")],
                 FreqSeverity="int", SeizureFree="double", DailyRateSF="double")
    scores = fq.severity_by_code(df)
    assert scores.count() == 3
    for hot_rows in (None, 0, 2):
        assert rows_of(fq.max_severity(scores, hot_rows=hot_rows), "LETTER") == [(1,), (2,)]
        both = fq.max_severity(scores, ["SYSTEM_ID", "DATEREC"], hot_rows)
        assert rows_of(both, "LETTER") == [(1,), (2,)]
    groups = spark.sql("SELECT * FROM VALUES ('A', 'x'), ('A', 'y'), ('B', NULL) AS t(CUI, Grouping)")
    grouped = fq.severity_grouped(scores, groups)
    assert rows_of(grouped, "LETTER", "Seizures") == [(0, "x"), (0, "y"), (2, "x"), (2, "y")]
    assert rows_of(fq.min_max_norm(grouped), "LETTER", "NV")[::2] == [(0, 0.0), (2, 1.0)]
    same = grouped.withColumn("FreqSeverity", F.lit(3))
    assert {r[0] for r in rows_of(fq.min_max_norm(same), "NV")} == {None}
    free, active = fq.rate_subsets(reports(
        [dict(SeizureFree=1.0), dict(DailyRateSF=0.0), dict(DailyRateSF=0.1)],
        SeizureFree="double", DailyRateSF="double"))
    assert rows_of(free, "LETTER") == [(0,)] and rows_of(active, "LETTER") == [(2,)]


def test_person_timeline(spark, frame):
    d = date(2015, 1, 1)
    doses = frame("SYSTEM_ID int, LETTER int, DATEREC date, CUI string, PREF string, "
                  "DailyDose double, TopDose double, DailyRate double",
                  [(1, 1, d, "M", "drug", 5.0, 10.0, 0.5)] * 2 + [(2, 2, d, "M", "drug", 1.0, None, None)])
    grouped = frame("SYSTEM_ID int, DATEREC date, LETTER int, CUI string, FreqSeverity int, "
                    "Seizures string", [(1, d, 1, "C", 7, "focal"), (2, None, 2, "C", 1, "focal")])
    everyone = fq.person_timeline(doses, grouped)
    assert everyone.columns == ["SYSTEM_ID", "LETTER", "DATEREC", "CUI", "Category", "NV",
                                "FreqSeverity"]
    assert rows_of(everyone) == [
        (1, 1, d, "C", "focal", 1.0, 7), (1, 1, d, "M", "drug", 0.5, None),
        (2, 2, None, "C", "focal", 0.0, 1), (2, 2, d, "M", "drug", None, None)]
    # Scaling stays over all people.
    assert rows_of(fq.person_timeline(doses, grouped, 2)) == rows_of(
        everyone.filter("SYSTEM_ID = 2"))


def test_reports_are_dated_by_letter_or_doc(frame):
    names = ("Start", "End", "CUI", "FreqChange", "NofS", "LNofS", "UNofS", "TP", "NofTP", "LNofTP",
             "UNofTP", "Sin_Dur", "YD", "MD", "DD", "PinT")
    schema = "SYSTEM_ID string, Letter string, " + ", ".join(
        f"{n} {SF.get(n, 'int' if n in ('Start', 'End') else 'double')}" for n in names)
    annotations = frame(schema, [("p", "L", 1, 2, "C", None, 3.0, None, None, "Day", 1.0)
                                 + (None,) * 7])
    dates = frame("SYSTEM_ID string, LETTER string, DOC int, Clinic_Date string, LetDate string",
                  [("p", "L", 5, "1/2/2015", None)])
    for by, value in (("LETTER", "L"), ("DOC", 5)):
        dated = dated_reports(annotations, dates, by)
        assert dated.columns == ["SYSTEM_ID", "DATEREC", by, *names]
        assert rows_of(dated, "DATEREC", by) == [(date(2015, 2, 1), value)]
        assert rows_of(fq.severity_table(dated), "FreqSeverity") == [(7,)]
