"""Common keys: results must not depend on where a group counts as common."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from letterflow.operators import dose, frequency, skew, validation
from letterflow.operators.joins import (
    anti_join_sql, factored_join, join_null_safe, lookup_join, planned_bytes, semi_flag)
from letterflow.operators.skew import LANE, hot_keys, in_lanes, null_safe, salted
from letterflow.plans import validation as validation_plan
from letterflow.sources.scan import scan_table
from letterflow.sources.schemas import TABLE_SCHEMAS
from work import work_done

SF = ("SYSTEM_ID string, LETTER int, Start int, DATEREC date, CUI string, FreqChange string, "
      "NofS double, UNofS double, TP string, NofTP double, LNofTP double, Sin_Dur string, "
      "YD int, MD int, DD int, PinT string")


def reports(seed, n):
    """Reports of few people: one holds most rows, many on one date, many alike."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        person = r.choice(["hot"] * 6 + ["a", "b", None])
        day = r.choice([0, 0, 0, 30, 31, 400, r.randrange(900), None])
        row = (person, r.randrange(n), r.randrange(4),
               None if day is None else date(2015, 1, 1) + timedelta(days=day),
               r.choice(["C0", "C0", "C1", "C2", None]), r.choice(["Same", None]),
               r.choice([None, 0.0, 3.0, 5.0]), r.choice([None, 2.0]),
               r.choice(["Day", "Week", "Month", "Year", None]), r.choice([None, 1.0, 3.0]),
               r.choice([None, 2.0]), r.choice(["Since", "During", None]),
               r.choice([None, 2014, 2015]), r.choice([None, 2, 7]), r.choice([None, 1, 30]),
               r.choice(["LastClinic", "Last_Month", "Last_Year", "This_Year", None]))
        rows += [row] * r.choice([1, 1, 1, 40])
    return rows


@pytest.mark.parametrize("variant", frequency.VARIANTS)
@pytest.mark.parametrize("seed,n", [(1, 60), (2, 150)])
def test_look_backs_are_the_same_for_common_people(frame, variant, seed, n):
    df = frame(SF, reports(seed, n), 7)
    plain = frequency.frequency_table(df, variant, hot_rows=None)
    for hot_rows in (0, 20):
        spread = frequency.frequency_table(df, variant, hot_rows=hot_rows)
        assert rows_of(spread.select(plain.columns)) == rows_of(plain)


def test_lane_zero_is_small_and_no_row_is_lost(frame):
    rows = [("hot", date(2015, 1, 1 + i % 3), "C0", i % 2) for i in range(5000)]
    df = frame("SYSTEM_ID string, DATEREC date, CUI string, LETTER int", rows, 5)
    order = [F.asc_nulls_last(c) for c in ("DATEREC", "CUI", "LETTER")]
    lanes = in_lanes(df, ["SYSTEM_ID"], ["SYSTEM_ID", "DATEREC"], order, 6, hot_rows=1000)
    sizes = {r[LANE]: r["count"] for r in lanes.groupBy(LANE).count().collect()}
    assert sum(sizes.values()) == 5000
    assert sizes[0] == 3 * 12
    assert max(sizes.values()) <= 1100
    assert rows_of(lanes.drop(LANE)) == rows_of(df)


PRESC = ("SYSTEM_ID int, LETTER string, START int, `END` int, CUI string, NAME string, "
         "DOSE double, UNIT string, FREQUENCY double")


def prescriptions(seed, n):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        row = (1, r.choice(["hot"] * 5 + ["x", "y", None]), r.choice([1, 1, 1, 2, 3, None]),
               r.choice([5, 6]), r.choice(["C0055891", "C1", "C1", None]), r.choice(["m", "n"]),
               r.choice([1.0, 2.0, None]), r.choice(["mg", "g", "ml"]),
               r.choice([1.0, 1.0, 1.0, 2.0, None]))
        rows += [row] * r.choice([1, 1, 2, 30])
    return rows


@pytest.mark.parametrize("rule", ["matched", "previous"])
@pytest.mark.parametrize("seed,n", [(1, 40), (2, 90), (3, 90)])
def test_doses_are_the_same_for_common_letters(frame, rule, seed, n):
    df = frame(PRESC, prescriptions(seed, n), 6)
    plain = dose.total_daily_dose(df, rule, hot_rows=None)
    for hot_rows in (0, 25):
        spread = dose.total_daily_dose(df, rule, hot_rows=hot_rows)
        assert rows_of(spread.select(plain.columns)) == rows_of(plain)


def test_span_partition_equals_letter_partition(frame):
    """Leading the order with START lets the window split by span."""
    rows = [r for r in prescriptions(4, 80) if r[1] is not None and r[2] is not None]
    df = frame(PRESC, rows)
    by_span = dose.total_daily_dose(df)
    # The same order under another leading column, constant per letter.
    by_letter = dose.total_daily_dose(df, order=("SYSTEM_ID", *dose.DOSE_ORDER))
    assert rows_of(by_span) == rows_of(by_letter.select(by_span.columns))


LEFT = [("hot", i) for i in range(40)] + [("a", 1), ("b", 2), ("b", 3), (None, 4), (None, 5)]
RIGHT = [("hot", "h1"), ("hot", "h2"), ("b", "b1"), ("c", "c1"), (None, "n1")] + [
    ("wide", str(i)) for i in range(30)] + [("a", str(i)) for i in range(30)]


def brute(how, nulls_match):
    def same(x, y):
        return x == y and (nulls_match or x is not None)
    out, used = [], set()
    for k, v in LEFT:
        hits = [i for i, (rk, _) in enumerate(RIGHT) if same(k, rk)]
        used |= set(hits)
        if how == "left_semi":
            out += [(k, v)] if hits else []
        elif how == "left_anti":
            out += [] if hits else [(k, v)]
        else:
            out += [(k, v, RIGHT[i][1]) for i in hits]
            if not hits and how in ("left", "full"):
                out.append((k, v, None))
    if how == "full":
        out += [(k, None, w) for i, (k, w) in enumerate(RIGHT) if i not in used]
    return sorted(out, key=repr)


@pytest.mark.parametrize("nulls_match", [True, False])
@pytest.mark.parametrize("how", ["inner", "left", "full", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows,right_hot_rows", [
    (None, None), (0, None), (0, 0), (10, 10), (1000, 0), (10, 1000)])
def test_joins_against_brute_force(frame, how, nulls_match, hot_rows, right_hot_rows):
    left, right = frame("k string, v int", LEFT, 6), frame("k2 string, w string", RIGHT, 4)
    got = join_null_safe(left, right, {"k": "k2"}, how, hot_rows, salts=5,
                         nulls_match=nulls_match, right_hot_rows=right_hot_rows)
    assert rows_of(got) == brute(how, nulls_match)


def test_a_common_key_meets_many_tasks(frame):
    left = frame("k string, v int", [("hot", i) for i in range(3000)] + [("a", 1)], 10)
    right = frame("_r_k string, w string", [("hot", "h"), ("a", "a"), ("q", "q")])
    spread, repeated = salted(left, right, ["k"], hot_keys(left, ["k"], 100), null_safe, salts=10)
    sizes = [r["count"] for r in spread.groupBy("k", "_salt").count().collect()]
    assert sum(sizes) == 3001 and max(sizes) <= 400
    copies = {r["_r_k"]: r["count"] for r in repeated.groupBy("_r_k").count().collect()}
    assert copies == {"hot": 10, "a": 1, "q": 1}


def test_common_keys_include_null(frame):
    left = frame("k string, v int", LEFT + [(None, 9)] * 20)
    hot = hot_keys(left, ["k"], 15)
    assert rows_of(hot, "_h_k") == sorted([("hot",), (None,)], key=repr)


def test_lookup_falls_back_without_broadcast(spark, frame):
    left = frame("k string, v int", LEFT)
    small = spark.sql("SELECT * FROM VALUES ('hot', 'h'), ('b', 'x') AS t(k, w)")
    assert planned_bytes(small) < 1000
    want = rows_of(lookup_join(left, small, "k"))
    unhinted = lookup_join(left, small, "k", max_bytes=0, hot_rows=10)
    assert rows_of(unhinted) == want
    assert "BroadcastHint" not in lookup_join(left, small, "k", max_bytes=0)._jdf \
        .queryExecution().analyzed().toString().split("_r_k")[-1]


def test_sql_anti_join_and_flag(frame):
    left, right = frame("k string, v int", LEFT), frame("k string, w string", RIGHT)
    right = right.filter("k <> 'a' OR k IS NULL")
    assert rows_of(anti_join_sql(left, right, "k", hot_rows=10)) == [("a", 1)]
    flagged = semi_flag(left, right, "k", hot_rows=10)
    assert Counter(r[2] for r in rows_of(flagged)) == {True: 44, False: 1}


def test_parts_follow_the_rows_of_a_key(frame):
    left = frame("k string, v int", [("hot", i) for i in range(4000)] + [("warm", i) for i in range(60)], 400)
    right = frame("_r_k string, w string", [("hot", "h"), ("warm", "w"), ("q", "q")])
    hot = hot_keys(left, ["k"], 20)
    assert rows_of(hot) == [("hot", 200), ("warm", 3)]
    spread, repeated = salted(left, right, ["k"], hot, null_safe)
    sizes = [r["count"] for r in spread.filter("k = 'hot'").groupBy("_salt").count().collect()]
    assert len(sizes) == 200 and max(sizes) <= 2 * 20
    copies = {r["_r_k"]: r["count"] for r in repeated.groupBy("_r_k").count().collect()}
    assert copies == {"hot": 200, "warm": 3, "q": 1}


def test_common_keys_must_be_few(frame, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_HOT_ROWS", 10_000)
    with pytest.raises(ValueError, match="at least 10000"):
        hot_keys(frame("k string, v int", LEFT), ["k"], 5)


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_common_keys_can_be_passed_along(frame, how):
    left, right = frame("k string, v int", LEFT, 6), frame("k2 string, w string", RIGHT, 4)
    got = join_null_safe(left, right, {"k": "k2"}, how, hot=hot_keys(left, ["k"], 10),
                         right_hot=hot_keys(right, ["k2"], 10))
    assert rows_of(got) == brute(how, True)


def test_rows_of_no_group_are_spread_by_rule(frame):
    rows = [(None, date(2015, 1, 1), "C0", i) for i in range(600)] + [("p", date(2015, 1, 2), "C0", 1)]
    df = frame("SYSTEM_ID string, DATEREC date, CUI string, LETTER int", rows, 6)
    order = [F.asc_nulls_last(c) for c in ("DATEREC", "CUI", "LETTER")]
    lanes = in_lanes(df, ["SYSTEM_ID"], ["SYSTEM_ID", "DATEREC"], order, 6)
    sizes = {r[LANE]: r["count"] for r in lanes.groupBy(LANE).count().collect()}
    assert sizes.pop(0) == 1 and len(sizes) == 6 and max(sizes.values()) < 130


def test_columns_of_both_sides(spark, frame):
    left, right = frame("k string, SYSTEM_ID int", [("a", 1)]), frame("k string, SYSTEM_ID int", [("a", 2)])
    with pytest.raises(ValueError, match="SYSTEM_ID"):
        join_null_safe(left, right, "k")
    both = join_null_safe(left, right, "k", suffix="_2")
    assert both.columns == ["k", "SYSTEM_ID", "SYSTEM_ID_2"] and rows_of(both) == [("a", 1, 2)]
    assert rows_of(join_null_safe(left, right, "k", "left_semi")) == [("a", 1)]


def test_scanned_dates_with_scanned_letters(spark, tmp_path):
    (tmp_path / "dates.csv").write_text("SYSTEM_ID:LETTER:Clinic_Date:LetDate\n7:a:01/02/2015:\n8:b::03/04/2016\n")
    (tmp_path / "letters.csv").write_text("SYSTEM_ID,LETTER,DOC\n7,a,d1\n9,c,d2\n")
    table = scan_table(spark, str(tmp_path / "dates.csv"), TABLE_SCHEMAS["clinic_letter_dates"], ":")
    letters = scan_table(spark, str(tmp_path / "letters.csv"), TABLE_SCHEMAS["letter_list"])
    with pytest.raises(ValueError, match="SYSTEM_ID"):
        validation.dates_with_letters(table, letters)
    both = validation.dates_with_letters(table, letters, suffix="_listed")
    assert rows_of(both, "LETTER", "SYSTEM_ID", "SYSTEM_ID_listed", "DOC") == sorted(
        [("a", "7", "7", "d1"), ("b", "8", None, None), ("c", None, "9", "d2")], key=repr)


def test_common_keys_by_sketch(frame):
    left = frame("k string, v int", [("hot", i) for i in range(5000)] + [(f"x{i}", i) for i in range(3000)]
                 + [(None, 1)] * 4000, 6)
    right = frame("k string, w int", [("warm", i) for i in range(900)] + [("hot", 1)])
    first, second = skew.frequent_keys([left, right], "k", hot_rows=500)
    assert rows_of(first) == [("hot", 10)] and rows_of(second) == [("warm", 2)]
    none = frame("k string, v int", [])
    assert [rows_of(h) for h in skew.frequent_keys([none, right], "k", 500)] == [[], [("warm", 2)]]


def test_full_joins_spread_common_letters_without_a_list(frame):
    """A letter with a third of all rows on each side: rows as in the plain joins, dealt over many parts."""
    clinic = frame("LETTER string, Clinic_Date string", [("hot", str(i)) for i in range(60)] + [
        (f"a{i}", "1") for i in range(100)] + [(None, "n")], 4)
    letter = frame("LETTER string, LetDate string", [("hot", str(i)) for i in range(40)] + [
        (f"a{i}", "2") for i in range(50, 130)] + [(None, "m")], 4)
    listed = frame("LETTER string, DOC int", [("hot", 1), ("hot", 2)] + [(f"a{i}", i) for i in range(140)], 3)
    plain = validation.dates_with_letters(validation.clinic_letter_full(clinic, letter), listed)
    for hot_rows in (1, 10):
        spread = validation_plan.date_tables(clinic, letter, listed, hot_rows=hot_rows)
        assert rows_of(spread) == rows_of(plain)
    hot, _ = skew.frequent_keys([clinic, letter], "LETTER", 10)
    parts, _ = salted(clinic, letter.withColumnRenamed("LETTER", "_r_LETTER"), ["LETTER"], hot, null_safe)
    sizes = [r["count"] for r in parts.filter("LETTER = 'hot'").groupBy("_salt").count().collect()]
    assert len(sizes) >= 3 and max(sizes) <= 40


def test_rows_without_a_key_are_not_multiplied(frame):
    """A third without a letter on both sides: two aggregates instead of their product."""
    left = frame("k string, v int", [(None, i % 4) for i in range(300)] + [(f"a{i}", i) for i in range(600)], 5)
    right = frame("k string, w int", [(None, i % 3) for i in range(200)] + [(f"a{i}", i) for i in range(0, 400, 2)], 4)
    factored = factored_join(left, right, "k")
    assert factored.left.count() == 4 and factored.right.count() == 3 and factored.known.count() == 600
    assert tuple(factored.rows().first()) == (600, 300, 200, 600 + 300 * 200)
    assert work_done(factored.rows())["shuffled"] < 5000
    small = frame("k string, v int", [(None, 1), (None, 1), (None, 2), ("a0", 3), ("z", 4)])
    few = right.filter("k = 'a0' or (k is null and w = 1)").limit(9)
    for other in (few, few.filter("k is not null"), few.filter("k is null")):
        whole = join_null_safe(small, other, "k", "left")
        got = factored_join(small, other, "k")
        assert rows_of(got.expanded()) == rows_of(whole)
        assert got.rows().first()["total"] == whole.count()
