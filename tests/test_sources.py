from datetime import date

import pytest

from pyspark.sql import functions as F

from checks.adapters import load
from conftest import rows_of
from letterflow.functions import scalars as sc
from letterflow.operators.dates import normalise_annotations
from letterflow.sources import scan, schemas
from letterflow.sources.scan import (
    null_tokens, register_views, scan_annotations, scan_table, upper_names)
from letterflow.sources.schemas import ANNOTATION_SCHEMAS, KINDS, OLD_SEPARATOR, TABLE_SCHEMAS
from letterflow.sources.sink import keep, save

WHOLE = "/root/testdata/sf0.01"

# Columns per file of the two generations.
WIDTHS = {"SeizureFrequency": (42, 37), "Diagnosis": (26, 22), "BirthHistory": (26, 21),
          "EpilepsyCause": (26, 21), "Investigations": (31, 25), "Onset": (38, 33),
          "Prescription": (27, 20), "PatientHistory": (38, 34), "WhenDiagnosed": (38, 33)}


@pytest.mark.parametrize("kind", KINDS)
def test_layout_widths(kind):
    assert (len(ANNOTATION_SCHEMAS[kind, "new"]), len(ANNOTATION_SCHEMAS[kind, "old"])) \
        == WIDTHS[kind]


@pytest.mark.parametrize("generation", ["new", "old"])
@pytest.mark.parametrize("kind", KINDS)
def test_every_kind_is_scanned_and_dated(spark, tmp_path, kind, generation):
    schema = ANNOTATION_SCHEMAS[kind, generation]
    known = {"Letter": "L1", "Start": "7", "CUI": " C1 ", "ClinicDD": "3", "ClinicMD": "11",
             "ClinicYD": "15", "DoBDD": "1", "DoBMD": "2", "DoBYD": "73", "Certainty": "5",
             "NHS_No": "400 000-0000", "Hosp_No": "H 1-2", "Surname": "Ann"}
    sep = ":" if generation == "old" and kind in (
        "SeizureFrequency", "Investigations", "Prescription") else ","
    line = sep.join(known.get(f.name, " null") for f in schema)
    path = tmp_path / "file.csv"
    path.write_text(line + "\n" + line.replace("L1", "L2") + "\n")
    df = scan_annotations(spark, str(path), kind, generation)
    assert "Last" not in df.columns
    rows = normalise_annotations(df).orderBy("Letter").collect()
    assert [r.Letter for r in rows] == ["L1", "L2"]
    row = rows[0]
    assert (row.Start, row.CUI, row.End) == (7, "C1", None)
    assert row.DATEREC == row.Clinic_Date == date(2015, 11, 3) and row.Let_Date is None
    no_birthday = generation == "old" and kind == "Prescription"
    assert row.DoB == (None if no_birthday else date(1973, 2, 1))
    assert (row.NHS_No, row.Hosp_No) == ("4000000000", "H1-2")


def test_event_parts_are_kept_on_request(spark, tmp_path):
    path = tmp_path / "sf.csv"
    path.write_text(",".join("1" for _ in ANNOTATION_SCHEMAS["SeizureFrequency", "new"]) + "\n")
    df = scan_annotations(spark, str(path), "SeizureFrequency")
    assert not {"YD", "MD", "DD"} & set(normalise_annotations(df).columns)
    assert {"YD", "MD", "DD"} <= set(normalise_annotations(df, keep=("YD", "MD", "DD")).columns)


def test_table_with_header_and_round_trip(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("SYSTEM_ID:Letter:Start:End:CUI:Name:Dose:Unit:Frequency\n"
                    "1:L1:5:9: C1 :Keppra: 250 :mg:2\n"
                    "2:L2:x:9:NULL:NA:many:g: null\n")
    df = scan_table(spark, str(path), TABLE_SCHEMAS["prescriptions"], ":")
    want = [("1", "L1", 5, 9, "C1", "Keppra", 250.0, "mg", 2.0),
            ("2", "L2", None, 9, None, None, None, "g", None)]
    assert rows_of(df) == want
    assert upper_names(df).columns[1] == "LETTER"
    for fmt in ("parquet", "csv"):
        out = str(tmp_path / fmt)
        save(df, out, fmt)
        save(df, out, fmt)
        back = (spark.read.parquet(out) if fmt == "parquet"
                else scan_table(spark, out, TABLE_SCHEMAS["prescriptions"]))
        assert rows_of(back) == want
        assert back.columns == df.columns
    save(df, str(tmp_path / "parts"), partition_by=["SYSTEM_ID"])
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 2


def as_text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@pytest.mark.parametrize("sep", [":", ","])
def test_saved_tables_scan_back_with_a_header(spark, tmp_path, sep):
    """Every row of a view goes to a file with a header and comes back, typed and cleaned."""
    schema = TABLE_SCHEMAS["seizure_frequency"]
    view = load(spark, WHOLE, "sf_v").withColumnRenamed("LETTER", "Letter").withColumns(
        {"Start": F.lit(3), "End": F.lit(9), "LNofS": F.lit(None).cast("double"), "UNofTP": F.lit(1.5)})
    rows = view.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    path = str(tmp_path / "table")
    as_text(rows).write.option("header", True).option("sep", sep).csv(path)
    back = scan_table(spark, path, schema, sep)
    assert back.schema.names == schema.names
    assert back.count() == rows.count() > 10_000
    assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0


@pytest.mark.parametrize("generation", ["new", "old"])
@pytest.mark.parametrize("kind", KINDS)
def test_headerless_files_scan_back_by_position(spark, tmp_path, kind, generation):
    schema = ANNOTATION_SCHEMAS[kind, generation]
    view = load(spark, WHOLE, "ident_v").withColumn("Address", F.translate("Address", ",", " "))
    rows = view.select(*[
        (F.col(f.name) if f.name in view.columns else F.when(F.col("Letter") % 3 == 0, F.col("Letter") % 50))
        .cast(f.dataType).alias(f.name) for f in schema])
    sep = OLD_SEPARATOR.get(kind, ",") if generation == "old" else ","
    path = str(tmp_path / "annotations")
    as_text(rows).write.option("sep", sep).csv(path)
    back = scan_annotations(spark, path, kind, generation)
    want = null_tokens(rows).drop("Last")
    assert back.columns == want.columns and back.count() == rows.count()
    assert back.exceptAll(want).count() == 0


def test_saved_formats(spark, tmp_path):
    rows = load(spark, WHOLE, "letters_v")
    for fmt in ("csv", "parquet"):
        save(rows, str(tmp_path / fmt), fmt)
    text = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert text.columns == rows.columns and text.count() == rows.count()
    assert spark.read.parquet(str(tmp_path / "parquet")).exceptAll(rows).count() == 0


def test_null_tokens_only_whole_fields(frame):
    df = frame("a string, b string, n int", [(" null", "nullify", 1), ("NA ", " x ", 2)])
    assert rows_of(null_tokens(df)) == [(None, "nullify", 1), (None, "x", 2)]
    assert rows_of(null_tokens(df, tokens=("x",), cols=["b"])) == [
        (" null", "nullify", 1), ("NA ", None, 2)]


def test_kept_table_and_views(spark, frame, tmp_path):
    df = keep(frame("a int, b int", [(1, 5), (2, 6)]), str(tmp_path / "kept"))
    assert "ReadSchema: struct<a:int>" in df.select("a")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="already exists"):
        keep(df, str(tmp_path / "kept"))
    register_views(kept=df)
    assert spark.sql("SELECT sum(a) FROM kept").head()[0] == 3


def scalar(frame, schema, rows, column):
    df = frame("i int, " + schema, [(i, *r) for i, r in enumerate(rows)])
    return [r[1] for r in df.select("i", column).orderBy("i").collect()]


def test_numbers(frame):
    text = ["1", " 2.5 ", "1e2", "5d", "2f", "", "many", None]
    assert scalar(frame, "c string", [(t,) for t in text], sc.to_number("c")) == [
        1.0, 2.5, 100.0, None, None, None, None, None]


def test_dates_from_text_and_parts(frame):
    text = ["03/11/2015", "3/1/2015", "31/02/2015", "2015-01-01", None]
    assert scalar(frame, "c string", [(t,) for t in text], sc.parse_dmy("c")) == [
        date(2015, 11, 3), date(2015, 1, 3), None, None, None]
    parts = [(2015, 2, 29), (2016, 2, 29), (1900, 2, 29), (2015, 13, 1), (2015, 4, 31),
             (2015, 1, None), (None, 1, 1), (15, 3, 4), (2015, 0, 1), (12345, 1, 1), (2015, -1, 1)]
    assert scalar(frame, "y int, m int, d int", parts, sc.date_from_parts("y", "m", "d")) == [
        None, date(2016, 2, 29), None, None, None, None, None, date(15, 3, 4), None, None, None]


def test_years(frame):
    years = [(y,) for y in (1973, 73, 19, 5, 25, 26, 150, 1000, None)]
    assert scalar(frame, "y int", years, sc.expand_birth_year("y")) == [
        1973, 1973, 1919, 1905, 1925, 1926, None, None, None]
    assert scalar(frame, "y int", years, sc.expand_birth_year("y", 20)) == [
        1973, 1973, 2019, 2005, 1925, 1926, None, None, None]
    assert scalar(frame, "y int", years, sc.expand_visit_year("y")) == [
        1973, 1973, 2019, 2005, None, 1926, 2050, 2900, None]
    assert scalar(frame, "y int", years, sc.expand_visit_year("y", 25)) == [
        1973, 1973, 2019, 2005, 2025, 1926, 2050, 2900, None]


def test_division_and_rounding(frame):
    inf = float("inf")
    pairs = [(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None)]
    assert scalar(frame, "a double, b double", pairs, sc.safe_divide("a", "b")) == [
        0.5, inf, -inf, None, None, None]
    assert scalar(frame, "a double", [(0.125,), (0.135,), (2.344,), (inf,)], sc.round2("a")) == [
        0.12, 0.14, 2.34, inf]


def test_identifiers_and_gender(frame):
    assert scalar(frame, "c string", [("400 000-12",), (None,)], sc.normalise_id("c")) == [
        "40000012", None]
    genders = [("male",), ("female",), ("other",), (None,)]
    assert scalar(frame, "c string", genders, sc.gender_code("c")) == [1, 2, None, 9]


def test_every_line_is_read_or_rejected(spark, tmp_path):
    """Short, long and broken lines are told, with reasons; the others are read as ever."""
    lines = ["7:a:01/02/2015:", "8:b::03/04/2016", "9:c", "10:d:1/1/2015:2/1/2015:more", ' NA : "e:x" :null: 5/5/2015 ',
             'x:"f:1/1/2015:2/1/2015', "", "11"]
    (tmp_path / "dates.csv").write_text("SYSTEM_ID:LETTER:Clinic_Date:LetDate\n" + "\n".join(lines) + "\n")
    schema = TABLE_SCHEMAS["clinic_letter_dates"]
    rows, rejected = scan.scan_checked(spark, str(tmp_path / "dates.csv"), schema, ":")
    assert rows_of(rows, "SYSTEM_ID", "LETTER", "LetDate") == sorted(
        [("7", "a", None), ("8", "b", "03/04/2016"), (None, "e:x", "5/5/2015")], key=repr)
    assert rows_of(rejected, "line", "fields", "reason") == sorted([
        ("9:c", 2, "short"), ("10:d:1/1/2015:2/1/2015:more", 5, "long"), ('x:"f:1/1/2015:2/1/2015', 4, "broken"),
        ("11", 1, "short")], key=repr)
    assert rows.count() + rejected.count() == len([x for x in lines if x])
    assert {r[0].split("/")[-1] for r in rows_of(rejected, "file")} == {"dates.csv"}
    plain = scan.scan_table(spark, str(tmp_path / "dates.csv"), schema, ":")
    good = {r[0] for r in rows_of(rows, "LETTER")}
    assert {r for r in rows_of(plain) if r[1] in good} == set(rows_of(rows))


def test_headerless_lines_are_checked_too(spark, tmp_path):
    names = [name for name, _ in schemas.annotation_fields("Diagnosis", "old")]
    whole, spare = ",".join(["1"] * len(names)), ",".join(["2"] * (len(names) - 3))
    (tmp_path / "d.csv").write_text(f"{whole}\n{spare}\n{whole}\n")
    rows, rejected = scan.scan_annotations_checked(spark, str(tmp_path / "d.csv"), "Diagnosis", "old")
    assert rows.columns == [n for n in names if n != schemas.SPARE] and rows.count() == 2
    assert rows_of(rejected, "fields", "reason") == [(len(names) - 3, "short")]
