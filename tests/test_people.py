"""Diagnosis, identity and validation."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from letterflow.operators import diagnosis, identity, validation
from letterflow.plans import validation as questions
from letterflow.plans.identity import link

DX = "Letter int, Start int, Certainty int, DiagCategory string, CUI string, NHS_No string"


def test_diagnosis_class(frame):
    cases = [(5, "Epilepsy", "Epilepsy"), (4, "MultipleSeizures", "Epilepsy"), (3, "Epilepsy", None),
             (5, "SingleSeizure", "NO"), (1, "SingleSeizure", "NO"), (5, None, None),
             (None, "Epilepsy", None)]
    df = frame("i int, Certainty int, DiagCategory string",
               [(i, c, k) for i, (c, k, _) in enumerate(cases)])
    got = diagnosis.diagnosis_class(df).orderBy("i").collect()
    assert [r.Diag for r in got] == [want for *_, want in cases]


def test_letters_people_and_types(spark, frame):
    df = diagnosis.diagnosis_class(frame(DX, [
        (1, 1, 5, "Epilepsy", "C0014544", "400 1"), (1, 2, 5, "SingleSeizure", "S", "400 1"),
        (1, 2, 5, "SingleSeizure", "S", "400 1"), (2, 1, 5, "SingleSeizure", "S", None),
        (3, 1, 5, "MultipleSeizures", "M", "400-2"), (4, 1, 2, "Epilepsy", "C9", "400 3"),
        (5, 1, 4, "Epilepsy", "C9", "400-1"), (6, 1, 5, "Epilepsy", "C8", None),
        (7, 1, 5, "Epilepsy", None, "400 9")]))
    assert rows_of(diagnosis.letter_epilepsy(df)) == [
        (1, "Epilepsy"), (2, None), (3, "Epilepsy"), (4, None), (5, "Epilepsy"), (6, "Epilepsy"),
        (7, "Epilepsy")]
    assert diagnosis.annotation_diagnosis(df).count() == 8
    assert (1, "NO") in rows_of(diagnosis.letter_diagnosis(df))
    assert rows_of(diagnosis.people_with_epilepsy(df)) == [("4001",), ("4009",)]
    specific = diagnosis.specific_type(df)
    # An unknown code is not known to be specific.
    assert rows_of(specific, "Letter") == [(4,), (5,), (6,)]
    assert rows_of(diagnosis.people(specific)) == [("4001",), ("4003",)]
    types = spark.sql("SELECT * FROM VALUES ('C9', 'Focal'), ('C9', 'Focal'), ('C8', 'Generalised'),"
                      " ('C7', 'Other') AS t(CUI, EpilepsyType)")
    assert rows_of(diagnosis.type_counts(specific, types)) == [("Focal", 2), ("Generalised", 0)]


PERSON = ("Letter int, NHS_No string, Hosp_No string, Surname string, FirstName string, DoB date, "
          "Gender string, PostCode string, Address string")
BORN = date(1973, 2, 1)


def person(letter, nhs, surname="Ann", first="A", born=BORN, gender="male", post="P1", address=None):
    return (letter, nhs, None, surname, first, born, gender, post, address)


PEOPLE = [
    person(1, None, address="2, High St"), person(2, "n1", "ANN", address="3, High St"),
    person(3, "n2", address=None), person(4, None, "Bob", post=None, address="z"),
    person(5, "n3", None), person(6, "n4", born=None), person(7, "n1", post="P2"),
    person(8, "n5", "Cy", gender="other"), person(9, None, "Di", None, gender=None, post=None),
    person(10, "n6", "Di", None, gender=None, post=None),
] + [person(11, "n1")] * 30


@pytest.mark.parametrize("hot_rows", [None, 1_000_000, 0])
def test_identity_file_and_matching(frame, hot_rows):
    df = frame(PERSON, PEOPLE, 5)
    ind = identity.individuals([df.filter("Letter <= 5"), df.filter("Letter > 5")])
    assert ind.count() == ind.distinct().count() == 11
    assert identity.individuals_known(ind).count() == 7
    file = identity.identity_file(ind, "2024-01-31")
    assert file.columns == ["NHS_NUMBER", "SURNAME", "FORENAME", "DATE_OF_BIRTH", "GENDER_CD",
                            "POSTCODE", "ADDRESS_1", "SYSTEM_ID", "CREATE_DATE"]
    assert rows_of(file, "NHS_NUMBER", "SURNAME", "POSTCODE", "GENDER_CD", "ADDRESS_1") == sorted([
        ("n1", "ANN", "P1", 1, "2 High St"), ("n2", "ANN", "P1", 1, "2 High St"),
        (None, "BOB", None, 1, "z"), ("n1", "ANN", "P2", 1, None), ("n5", "CY", "P1", None, None),
        ("n6", "DI", None, 9, None)], key=repr)
    assert [r[0] for r in rows_of(file, "SYSTEM_ID")] == [1, 2, 3, 4, 5, 6]
    assert {r[0] for r in rows_of(file, "CREATE_DATE")} == {date(2024, 1, 31)}
    matched = identity.match_identity(df, file, hot_rows)
    got = {}
    for r in matched.collect():
        got.setdefault(r.Letter, []).append(r.NHS_NUMBER)
    # Two numbers for one identity repeat its annotations; NULL keys match NULL.
    assert sorted(got[1]) == sorted(got[2]) == ["n1", "n2"]
    assert got[4] == [None] and got[7] == ["n1"] and got[9] == got[10] == ["n6"]
    assert got[5] == got[6] == [None] and len(got[11]) == 60
    unmatched = [r.Letter for r in matched.filter("SYSTEM_ID IS NULL").collect()]
    assert sorted(unmatched) == [5, 6]


def test_row_ids_do_not_depend_on_partitions(frame):
    rows = [(f"k{i % 50}", i) for i in range(400)]
    one = identity.with_row_ids(frame("a string, b int", rows, 1))
    many = identity.with_row_ids(frame("a string, b int", rows[::-1], 9))
    assert rows_of(one) == rows_of(many)
    assert sorted(r[2] for r in rows_of(one)) == list(range(1, 401))


def test_link_and_cohort(frame):
    parts = ("CUI string, Certainty int, NHS_No string, Hosp_No string, Surname string, "
             "FirstName string, Gender string, PostCode string, Address string, DoBDD int, DoBMD int, "
             "DoBYD int, ClinicDD int, ClinicMD int, ClinicYD int, LetDD int, LetMD int, LetYD int")
    tail = ("Ann", "A", "male", "P", "x", 1, 2, 73, 3, 4, 15, None, None, None)
    history = frame(parts, [("C3495874", 4, "4 00", "h", *tail), ("C3495874", 3, None, "h", *tail),
                            ("C9", 5, None, "h", *tail)])
    diagnoses = frame(parts, [("C1142430", 5, None, "h", "Zed", *tail[1:])])
    file, matched = link({"PatientHistory": history, "Diagnosis": diagnoses}, "2024-01-31")
    assert file.count() == 2
    assert {r[0] for r in rows_of(matched["PatientHistory"], "NHS_NUMBER")} == {"400"}
    assert {r[0] for r in rows_of(matched["PatientHistory"], "DATEREC")} == {date(2015, 4, 3)}
    assert identity.code_cohort(matched["PatientHistory"]).count() == 1
    everyone = [m.select("SYSTEM_ID", "CUI", "Certainty") for m in matched.values()]
    assert identity.code_cohort(everyone[0].unionByName(everyone[1])).count() == 2
    assert rows_of(identity.people_count([history, diagnoses])) == [(1,)]


A = [(1, "x"), (1, "y"), (2, "x"), (3, "z"), (3, None)] + [(4, "x")] * 20
B = [(1, "x"), (2, "x"), (5, "w"), (6, None), (None, "q")]


@pytest.mark.parametrize("hot_rows", [None, 0, 10])
def test_values_against_the_trusted_list(frame, hot_rows):
    a, b = frame("SYSTEM_ID int, V string", A, 4), frame("SYSTEM_ID int, T string", B)
    pairs = validation.value_match(a, b, "V", "T", hot_rows=hot_rows)
    assert rows_of(pairs.filter("SYSTEM_ID < 4")) == sorted([
        (1, "x", "x", 2), (1, "y", None, 0), (2, "x", "x", 2), (3, "z", None, 0),
        (3, None, None, 0)], key=repr)
    assert pairs.count() == len(A)
    assert rows_of(validation.value_match_by_id(a, b, "V", b_col="T", hot_rows=hot_rows)) == [
        (1, "x", True), (2, "x", True), (3, "z", False), (4, "x", True)]
    assert rows_of(validation.annotations_per_id(a)) == [(1, 2), (2, 1), (3, 2), (4, 20)]
    assert rows_of(validation.missed_ids(b, a, hot_rows=hot_rows)) == [(5,), (6,)]
    flags = validation.membership(a, b, "V", "T", hot_rows)
    # An unknown value is found if the list has an unknown value.
    assert rows_of(flags.filter("SYSTEM_ID = 3"), "V", "matched") == [("z", False), (None, True)]
    assert rows_of(validation.matched_values(a.filter("SYSTEM_ID < 4"), b, "V", "T", hot_rows)) == [
        ("x",), ("x",), (None,)]
    assert rows_of(validation.value_overlap(a, b, "V", "T")) == [(2, 1, 2)]


def test_questions_in_sql_give_the_same(spark, frame):
    a, b = frame("SYSTEM_ID int, V string", A), frame("SYSTEM_ID int, T string", B)
    assert rows_of(questions.ask(spark, "count", a, b, "V")) == rows_of(
        validation.annotations_per_id(a))
    assert rows_of(questions.ask(spark, "match", a, b, "V", "T")) == rows_of(
        validation.value_match_by_id(a, b, "V", b_col="T"))
    assert rows_of(questions.ask(spark, "missed", a, b, "V")) == rows_of(
        validation.missed_ids(b, a))


@pytest.mark.parametrize("hot_rows", [None, 0, 1])
def test_date_tables(frame, hot_rows):
    clinic = frame("LETTER string, Clinic_Date string", [("a", "1/2/2015"), ("b", "5/2/2015")])
    letter = frame("LETTER string, LetDate string", [("b", "4/2/2015"), ("c", "1/1/2015")])
    both = validation.clinic_letter_full(clinic, letter, hot_rows=hot_rows)
    assert rows_of(both) == [("a", "1/2/2015", None), ("b", "5/2/2015", "4/2/2015"),
                             ("c", None, "1/1/2015")]
    listed = frame("LETTER string, DOC int", [("a", 1), ("b", 1), ("d", 2)])
    full = validation.dates_with_letters(both, listed, hot_rows=hot_rows)
    assert rows_of(full, "LETTER", "DOC") == [("a", 1), ("b", 1), ("c", None), ("d", 2)]
    more = full.unionByName(full.filter("LETTER = 'c'"))
    assert rows_of(validation.duplicate_rows(more, "DOC", hot_rows), "LETTER") == [
        ("a",), ("b",), ("c",), ("c",)]
    assert rows_of(validation.without_clinic_date(full), "LETTER") == [("c",), ("d",)]
    assert rows_of(validation.date_order_check(full)) == [
        ("b", date(2015, 2, 5), date(2015, 2, 4), 1)]
    typed = full.withColumns({c: F.try_to_date(c, "d/M/yyyy") for c in ("Clinic_Date", "LetDate")})
    assert rows_of(validation.date_order_check(typed)) == rows_of(validation.date_order_check(full))
    sample = frame("LETTER string", [("b",), ("q",)])
    for limit in (0, 2 ** 63):
        got = validation.sample_dates(sample, both, max_bytes=limit, hot_rows=hot_rows)
        assert rows_of(got, "LETTER", "LetDate") == [("b", "4/2/2015"), ("q", None)]


def test_links_and_pairs_of_values(frame):
    a, b = frame("SYSTEM_ID int, V string", A, 4), frame("SYSTEM_ID int, T string", B)
    assert rows_of(validation.value_links(a, b, "V", "T")) == [
        ("q", 0, 1, 0), ("w", 0, 1, 0), ("x", 22, 2, 44), ("y", 1, 0, 0), ("z", 1, 0, 0)]
    pairs = rows_of(validation.value_pairs(a, b, "V", "T"))
    assert pairs == sorted([(i, v, t) for i, v in A for t in ([x for _, x in B if x == v and v is not None] or [None])], key=repr)


def test_pairs_of_a_common_value_are_shared_by_tasks(spark, frame):
    a = frame("SYSTEM_ID long, V string", [(k, "x") for k in range(64)] + [(64, "none")], 1)
    b = frame("T string", [("x",)] * 9000, 1)
    pairs = validation.value_pairs(a, b, "V", "T")
    tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 64 * 9000 + 1 and max(tasks) <= 64 * 9000 / 4
    assert {r["count"] for r in pairs.groupBy("SYSTEM_ID").count().collect()} == {9000, 1}
