"""One query per operator, over whole tables."""

from functools import reduce

from pyspark.sql import functions as F

from checks.adapters import load
from letterflow.functions import scalars as sc
from letterflow.functions.lookups import generic_names
from letterflow.operators import dates, diagnosis, dose, frequency, identity, validation
from letterflow.plans import frequency as frequency_plan
from letterflow.plans import identity as identity_plan
from letterflow.plans import prescriptions as prescription_plan
from letterflow.plans import validation as validation_sql
from letterflow.sources.scan import null_tokens
from letterflow.sources.schemas import KINDS
from letterflow.sources.sink import new_folder

# Lookup values for the test tables: generic names, top doses, groups and types.
NAME_MAP = (
    ("Alpha", "NAME", "ECONOMY"), ("Alpha", "CUI", "C1"), ("Beta", "NAME", "PROMO"),
    ("Beta", "CUI", "C2"), ("Gamma", "CUI", "C3"), ("Delta", "NAME", "SMALL"),
    ("Gamma", "NAME", "LARGE"), ("Epsilon", "CUI", "C5"),
)
TOP_DOSES = (("Alpha", 300.0), ("Beta", 70.0), ("Gamma", 900.0), ("Delta", 110.0))
GROUPS = (("C0", "Focal seizure"), ("C1", "Tonic clonic"), ("C1", "Any seizure"))
TYPES = (("C9000001", "Focal"), ("C9000002", "Generalised"))
NO_FREQUENCY_CODES = ("C3",)
AS_OF = "2024-01-31"


def values(spark, names, rows):
    """A small literal table whose size Spark knows."""
    text = ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(names)})")


def top_doses(spark):
    return values(spark, ("ASM", "Dose"), TOP_DOSES)


def groups(spark):
    return values(spark, ("CUI", "Grouping"), GROUPS)


QUERIES = {}


def query(f):
    QUERIES[f.__name__.rstrip("_")] = f
    return f


# --- scalars and sources -------------------------------------------------------------------

@query
def null_tokens_(spark, d):
    return null_tokens(load(spark, d, "typed_v"))


@query
def numeric_cast(spark, d):
    return load(spark, d, "typed_v").select("LETTER", sc.to_number("NumberText").alias("number"))


@query
def parse_dates(spark, d):
    return load(spark, d, "typed_v").select("LETTER", sc.parse_dmy("DateText").alias("date"))


@query
def date_from_parts(spark, d):
    return load(spark, d, "ident_v").select(
        "Letter", sc.date_from_parts(sc.expand_birth_year("DoBYD"), "DoBMD", "DoBDD").alias("DoB"))


@query
def expand_birth_year(spark, d):
    return load(spark, d, "ident_v").select(
        "Letter", sc.expand_birth_year("DoBYD").alias("literal"),
        sc.expand_birth_year("DoBYD", 30).alias("pivot30"))


@query
def expand_visit_year(spark, d):
    return load(spark, d, "ident_v").select(
        "Letter", sc.expand_visit_year("ClinicYD").alias("literal"),
        sc.expand_visit_year("ClinicYD", 25).alias("pivot25"))


@query
def normalise_ids(spark, d):
    return load(spark, d, "ident_v").select(
        "Letter", sc.normalise_id("NHS_No").alias("NHS_No"),
        sc.normalise_id("Hosp_No", " ").alias("Hosp_No"), F.upper("Surname").alias("Surname"))


@query
def gender_code(spark, d):
    return load(spark, d, "ident_v").select(
        "Letter", "Gender", sc.gender_code("Gender").alias("GENDER_CD"))


# --- record dates --------------------------------------------------------------------------

def dated(spark, d):
    return dates.record_date(load(spark, d, "dates_v"))


@query
def record_date(spark, d):
    return dated(spark, d)


@query
def normalise_annotations(spark, d):
    return dates.normalise_annotations(load(spark, d, "ident_v"))


@query
def letter_dates(spark, d):
    return dates.letter_dates(load(spark, d, "dates_v"), load(spark, d, "letters_v"))


@query
def dated_prescriptions_by_doc(spark, d):
    """Annotations by letter, dated and keyed by DOC."""
    linked = dates.letter_dates(load(spark, d, "dates_v"), load(spark, d, "letters_v"))
    annotations = load(spark, d, "presc_v").drop("DATEREC", "DOC")
    return prescription_plan.dated_prescriptions(annotations, linked, "DOC")


@query
def attach_record_date(spark, d):
    annotations = load(spark, d, "presc_v").drop("DATEREC")
    return dates.attach_record_date(annotations, dated(spark, d)).select(
        "LETTER", "START", "END", "CUI", "DOSE", "DATEREC")


def factored(spark, d):
    """Record dates of all prescriptions, where every third letter is not known on either side."""
    unknown = {"LETTER": F.when(F.col("LETTER") % 3 != 0, F.col("LETTER"))}
    annotations = load(spark, d, "presc_v").drop("DATEREC").withColumns(unknown)
    return dates.attach_record_date_factored(annotations, dated(spark, d).withColumns(unknown))


@query
def attach_record_date_factored(spark, d):
    """How many rows the join has, of known letters and in all, without making them."""
    return factored(spark, d).rows().select("known", "left", "right", "total")


@query
def letters_without_date(spark, d):
    return dates.letters_without_date(
        load(spark, d, "letters_v"), load(spark, d, "dates_v"), "LETTER")


@query
def letters_without_date_by_doc(spark, d):
    """Documents none of whose letters has a row in the date table; one date is enough."""
    linked = dates.letter_dates(load(spark, d, "dates_v"), load(spark, d, "letters_v"))
    return dates.letters_without_date(load(spark, d, "letters_v"), linked, "DOC")


@query
def distinct_letters(spark, d):
    return dates.distinct_letters(load(spark, d, "presc_v"))


# --- prescriptions -------------------------------------------------------------------------

ROW = ("LETTER", "START", "END", "CUI", "NAME", "DOSE", "UNIT", "FREQUENCY")


def doses(spark, d, **options):
    return dose.total_daily_dose(load(spark, d, "presc_v"),
                                 null_freq_codes=NO_FREQUENCY_CODES, **options)


@query
def quantity_mg(spark, d):
    return dose.quantity_mg(load(spark, d, "presc_v")).select(*ROW, "Quantity_mg")


@query
def split_dose_flag(spark, d):
    return dose.split_dose_flag(load(spark, d, "presc_v")).select(*ROW, "AnotherDose")


@query
def split_dose_qty(spark, d):
    return doses(spark, d).select(*ROW, "Quantity_mg", "AnotherDose", "Q2ndDose", "Q3rdDose")


@query
def split_dose_qty_previous(spark, d):
    return doses(spark, d, rule="previous").select(*ROW, "Q2ndDose", "Q3rdDose")


@query
def daily_dose(spark, d):
    return doses(spark, d).select(*ROW, "DailyDose")


@query
def split_dose_qty_ranged(spark, d):
    """Split doses across ranges that cut any letter."""
    return doses(spark, d, path=new_folder(spark, "doses")).select(
        *ROW, "Quantity_mg", "AnotherDose", "Q2ndDose", "Q3rdDose")


@query
def daily_dose_ranged(spark, d):
    return doses(spark, d, path=new_folder(spark, "doses")).select(*ROW, "DailyDose")


@query
def generic_name(spark, d):
    return dose.generic_name(load(spark, d, "presc_v"), NAME_MAP).select(*ROW, "PREF")


@query
def generic_name_table(spark, d):
    table = values(spark, ("generic", "match_col", "value", "priority"),
                   [(*entry, i) for i, entry in enumerate(NAME_MAP)])
    return dose.generic_name(load(spark, d, "presc_v"), table).select(*ROW, "PREF")


# The library's own medicine map, entry by entry.
MEDICINES = tuple(generic_names())
MEDICINE_NAMES = tuple(value for _, column, value in MEDICINES if column == "NAME") + ("unknown",)
MEDICINE_CODES = tuple(value for _, column, value in MEDICINES if column == "CUI") + ("C0",)


@query
def generic_name_medicines(spark, d):
    """Real names and codes dealt over all prescriptions, through the library's map."""
    pick = lambda values, key: F.element_at(
        F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))
    rows = load(spark, d, "presc_v").withColumns(
        {"NAME": pick(MEDICINE_NAMES, "LETTER"), "CUI": pick(MEDICINE_CODES, "SYSTEM_ID")})
    return dose.generic_name(rows).select(*ROW, "PREF")


@query
def daily_dose_clean(spark, d):
    return dose.daily_dose_clean(dose.generic_name(doses(spark, d), NAME_MAP))


@query
def daily_dose_clean_by_name(spark, d):
    return dose.daily_dose_clean(doses(spark, d, rule="previous"), dose.CLEAN_KEYS_BY_NAME)


@query
def max_daily_dose(spark, d):
    return prescription_plan.daily_doses(load(spark, d, "presc_v"), NAME_MAP,
                                         null_freq_codes=NO_FREQUENCY_CODES)


@query
def max_daily_dose_by_person(spark, d):
    rows = load(spark, d, "presc_v").drop("LETTER")
    return prescription_plan.daily_doses(rows, NAME_MAP, dose.CLEAN_KEYS_BY_PERSON, doc="DOC",
                                         null_freq_codes=NO_FREQUENCY_CODES)


@query
def max_dose_row(spark, d):
    return dose.max_dose_row(doses(spark, d, rule="previous"))


def ratios(spark, d):
    return prescription_plan.dose_ratios(
        load(spark, d, "presc_v"), top_doses(spark), NAME_MAP,
        null_freq_codes=NO_FREQUENCY_CODES)


@query
def dose_ratio(spark, d):
    return ratios(spark, d)


@query
def rows_per_person(spark, d):
    return dose.rows_per(ratios(spark, d), "SYSTEM_ID")


# --- seizure frequency ---------------------------------------------------------------------

def table(spark, d, variant="expanded"):
    return frequency.frequency_table(load(spark, d, "sf_v"), variant)


def per_variant(name, columns, variants=frequency.VARIANTS):
    """Register a query over the frequency columns for each rule set."""
    for variant in variants:
        key = name if variant == "expanded" else f"{name}_{variant}"
        QUERIES[key] = (lambda spark, d, v=variant, c=columns:
                        table(spark, d, v).select("LETTER", *c))


@query
def event_count(spark, d):
    return frequency.event_count(load(spark, d, "sf_v")).select("LETTER", "NumS")


@query
def event_count_basic(spark, d):
    return frequency.event_count(load(spark, d, "sf_v"), "basic").select("LETTER", "NumS")


@query
def event_date(spark, d):
    return frequency.event_date(load(spark, d, "sf_v")).select(
        "LETTER", "DATEREC", "EventDate", "EventDate2")


per_variant("stated_rate", ["NTP", "Days", "TotalTPDays", "DailyRate"])
per_variant("prev_record", ["SYSTEM_ID", "DATEREC", "PrevRecDate"], ["expanded"])


@query
def prev_record_distinct_dates(spark, d):
    return frequency.prev_record_date(load(spark, d, "sf_v"), distinct_dates=True).select(
        "LETTER", "SYSTEM_ID", "DATEREC", "PrevRecDate")


@query
def prev_same_code_date(spark, d):
    return frequency.prev_same_code(load(spark, d, "sf_v"), "DATEREC", "PrevRecCUI").select(
        "LETTER", "SYSTEM_ID", "DATEREC", "CUI", "PrevRecCUI")


per_variant("days_diff", ["DATEREC_Year", "DaysDiff"])
per_variant("since_rate", ["DailyRate2", "DailyRateF"])
per_variant("seizure_free", ["NumS", "SeizureFree"])
per_variant("prev_same_code_rate", ["DailyRateF", "PrevCUIFreq"])
per_variant("final_rate", ["PrevRateCUI_Same6m", "DailyRateSF"])


@query
def severity(spark, d):
    return frequency.severity_table(load(spark, d, "sf_v"))


@query
def severity_basic(spark, d):
    return frequency.severity_table(load(spark, d, "sf_v"), "basic")


@query
def severity_ranged(spark, d):
    """Look-backs across ranges that cut any person."""
    return frequency.severity_table(load(spark, d, "sf_v"), path=new_folder(spark, "reports"))


@query
def severity_basic_ranged(spark, d):
    return frequency.severity_table(load(spark, d, "sf_v"), "basic", path=new_folder(spark, "reports"))


@query
def prev_record_ranged(spark, d):
    return frequency.frequency_table(load(spark, d, "sf_v"), path=new_folder(spark, "reports")).select(
        "LETTER", "SYSTEM_ID", "DATEREC", "PrevRecDate")


@query
def prev_same_code_rate_ranged(spark, d):
    return frequency.frequency_table(load(spark, d, "sf_v"), path=new_folder(spark, "reports")).select(
        "LETTER", "DailyRateF", "PrevCUIFreq")


def scored(spark, d):
    return frequency_plan.scored_reports(
        load(spark, d, "sf_v"), path=new_folder(spark, "scores"))


def grouped(spark, d):
    return frequency_plan.grouped_severity(
        load(spark, d, "sf_v"), groups(spark), path=new_folder(spark, "scores"))


@query
def dated_reports(spark, d):
    """Reports by letter, dated from the whole date table."""
    return frequency_plan.dated_reports(
        load(spark, d, "sf_v").drop("DATEREC").withColumns(
            {"Start": F.lit(0), "End": F.lit(5)} | {
                c: F.lit(None).cast("double") for c in ("LNofS", "UNofTP")}),
        load(spark, d, "dates_v").drop("SYSTEM_ID"))


@query
def severity_by_code(spark, d):
    return frequency.severity_by_code(frequency.severity_table(load(spark, d, "sf_v")))


@query
def severity_grouped(spark, d):
    return grouped(spark, d)


@query
def rate_subsets(spark, d):
    free, active = frequency.rate_subsets(frequency.severity_table(load(spark, d, "sf_v")))
    return free.select("LETTER", F.lit("free").alias("subset")).unionByName(
        active.select("LETTER", F.lit("active").alias("subset")))


@query
def max_severity_by_date(spark, d):
    return frequency.max_severity(scored(spark, d))


@query
def max_severity_by_person_date(spark, d):
    return frequency.max_severity(scored(spark, d), ["SYSTEM_ID", "DATEREC"])


@query
def severity_norm(spark, d):
    return frequency_plan.normalised_severity(load(spark, d, "sf_v"), groups(spark), new_folder(spark, "severity"))


@query
def person_timeline(spark, d):
    return frequency_plan.timeline(
        ratios(spark, d), load(spark, d, "sf_v"), groups(spark), new_folder(spark, "severity"))


# --- diagnosis -----------------------------------------------------------------------------

def classed(spark, d):
    return diagnosis.diagnosis_class(load(spark, d, "dx_v"))


@query
def diagnosis_class(spark, d):
    return classed(spark, d).select("Letter", "Start", "Certainty", "DiagCategory", "Diag")


@query
def annotation_diagnosis(spark, d):
    return diagnosis.annotation_diagnosis(classed(spark, d))


@query
def letter_diagnosis(spark, d):
    return diagnosis.letter_diagnosis(classed(spark, d))


@query
def letter_epilepsy(spark, d):
    return diagnosis.letter_epilepsy(classed(spark, d))


@query
def people_with_epilepsy(spark, d):
    return diagnosis.people_with_epilepsy(classed(spark, d))


@query
def specific_type(spark, d):
    return diagnosis.specific_type(classed(spark, d))


@query
def people_with_specific_type(spark, d):
    return diagnosis.people(diagnosis.specific_type(classed(spark, d)))


@query
def type_counts(spark, d):
    return diagnosis.type_counts(diagnosis.specific_type(classed(spark, d)),
                                 values(spark, ("CUI", "EpilepsyType"), TYPES))


# --- identity ------------------------------------------------------------------------------

def annotated(spark, d):
    return dates.normalise_annotations(load(spark, d, "ident_v"))


def nine_tables(spark, d):
    """All annotations, as nine tables that together hold every row."""
    rows = annotated(spark, d)
    return [rows.filter(F.col("Letter") % 9 == k) for k in range(9)]


def file(spark, d):
    return identity.identity_file(identity.individuals(nine_tables(spark, d)), AS_OF)


def kept_file(spark, d):
    return identity.bucketed_identity(file(spark, d), new_folder(spark, "bucketed-identity"))


@query
def people_count(spark, d):
    return identity.people_count([load(spark, d, v) for v in ("ident_v", "dx_v")])


@query
def people_count_three(spark, d):
    trusted = load(spark, d, "trusted_v").withColumnRenamed("NHS_NUMBER", "NHS_No")
    return identity.people_count([load(spark, d, "ident_v"), load(spark, d, "dx_v"), trusted])


@query
def individuals(spark, d):
    return identity.individuals(nine_tables(spark, d))


@query
def individuals_known(spark, d):
    return identity.individuals_known(identity.individuals(nine_tables(spark, d)))


@query
def identity_file(spark, d):
    return file(spark, d)


@query
def match_identity(spark, d):
    return identity.match_identity(annotated(spark, d), kept_file(spark, d)).select(
        "Letter", "NHS_No", "Surname", "GENDER_CD", "NHS_NUMBER", "ADDRESS_1", "SYSTEM_ID",
        "CREATE_DATE")


@query
def code_cohort(spark, d):
    matched = identity.match_identity(annotated(spark, d), kept_file(spark, d))
    return identity.code_cohort(matched)


@query
def linked_kinds(spark, d):
    """Nine kinds of annotations, all matched to one identity file."""
    rows = load(spark, d, "ident_v")
    kinds = {kind: rows.filter(F.col("Letter") % len(KINDS) == k) for k, kind in enumerate(KINDS)}
    _, matched = identity_plan.link(kinds, AS_OF, new_folder(spark, "identity"))
    parts = [df.select(F.lit(kind).alias("kind"), "Letter", "NHS_NUMBER", "ADDRESS_1", "SYSTEM_ID")
             for kind, df in matched.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query
def identity_ids(spark, d):
    """Row ids by rule: one for each identity, from 1, without gaps."""
    ids = file(spark, d)
    return ids.agg(F.count("*").alias("rows"), F.count_distinct("SYSTEM_ID").alias("ids"),
                   F.min("SYSTEM_ID").alias("first"), F.max("SYSTEM_ID").alias("last"))


# --- validation ----------------------------------------------------------------------------

# Extracted column, its trusted column.
CHECKED = {"dob": ("DATE_OF_BIRTH", "DATE_OF_BIRTH"), "nhs": ("NHS_NUMBER", "NHS_NUMBER"),
           "gender": ("GENDER_CD", "GENDER_CD"), "postcode": ("POSTCODE", "PostCode")}


def extracted(spark, d, column):
    """One extracted value per annotation that has it."""
    rows = annotated(spark, d).withColumns({
        "SYSTEM_ID": F.regexp_extract("Hosp_No", r"(\d+)$", 1).cast("bigint"),
        "DATE_OF_BIRTH": F.col("DoB"), "NHS_NUMBER": F.col("NHS_No"),
        "GENDER_CD": F.when(F.col("Gender").isNotNull(), sc.gender_code("Gender")),
        "POSTCODE": F.col("PostCode")})
    return rows.select("SYSTEM_ID", column).filter(F.col(column).isNotNull())


def per_value(name):
    """Register a query for each of the four checked values; the plain name is the DoB's."""
    def register(f):
        for short, (column, trusted) in CHECKED.items():
            QUERIES[name if short == "dob" else f"{name}_{short}"] = (
                lambda spark, d, c=column, t=trusted:
                f(extracted(spark, d, c), load(spark, d, "trusted_v"), c, t))
        return f
    return register


@per_value("value_match")
def value_match(a, b, column, trusted):
    return validation.value_match(a, b, column, trusted)


@per_value("value_links")
def value_links(a, b, column, trusted):
    return validation.value_links(a, b, column, trusted)


for _short in ("dob", "nhs"):
    QUERIES["value_pairs" if _short == "dob" else f"value_pairs_{_short}"] = (
        lambda spark, d, c=CHECKED[_short]: validation.value_pairs(
            extracted(spark, d, c[0]), load(spark, d, "trusted_v"), *c))


@per_value("value_match_by_id")
def value_match_by_id(a, b, column, trusted):
    return validation.value_match_by_id(a, b, column, b_col=trusted)


@per_value("annotations_per_id")
def annotations_per_id(a, b, column, trusted):
    return validation.annotations_per_id(a)


@per_value("missed_ids")
def missed_ids(a, b, column, trusted):
    return validation.missed_ids(b, a)


@per_value("value_overlap")
def value_overlap(a, b, column, trusted):
    return validation.value_overlap(a, b, column, trusted)


@query
def value_membership(spark, d):
    return validation.membership(extracted(spark, d, "NHS_NUMBER"), load(spark, d, "trusted_v"),
                                 "NHS_NUMBER")


@query
def matched_values(spark, d):
    return validation.matched_values(extracted(spark, d, "NHS_NUMBER"),
                                     load(spark, d, "trusted_v"), "NHS_NUMBER")


def asked(question, column, trusted):
    def run(spark, d):
        return validation_sql.ask(spark, question, extracted(spark, d, column),
                                  load(spark, d, "trusted_v"), column, trusted)
    return run


for _question in validation_sql.QUESTIONS:
    for _short, (_column, _trusted) in CHECKED.items():
        # The plain name asks for the post code.
        _name = f"sql_{_question}" if _short == "postcode" else f"sql_{_question}_{_short}"
        QUERIES[_name] = asked(_question, _column, _trusted)


def two_date_tables(spark, d):
    rows = load(spark, d, "dates_v")
    return (rows.filter(F.col("Clinic_Date").isNotNull()).select("LETTER", "Clinic_Date"),
            rows.filter(F.col("LetDate").isNotNull()).select("LETTER", "LetDate"))


@query
def clinic_letter_full(spark, d):
    return validation.clinic_letter_full(*two_date_tables(spark, d))


def dates_and_docs(spark, d):
    both = validation.clinic_letter_full(*two_date_tables(spark, d))
    return validation.dates_with_letters(both, load(spark, d, "letters_v"))


@query
def dates_with_letters(spark, d):
    return dates_and_docs(spark, d)


@query
def dates_with_letters_common(spark, d):
    """Every letter of more than one row counts as common, as a sketch finds it."""
    return validation_sql.date_tables(*two_date_tables(spark, d), load(spark, d, "letters_v"), hot_rows=1)


@query
def duplicate_docs(spark, d):
    return validation.duplicate_rows(dates_and_docs(spark, d), "DOC", path=new_folder(spark, "dates"))


@query
def sample_dates(spark, d):
    """The letters that have a row in another table stand for the reviewed sample."""
    sample = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("LETTER"))
    return validation.sample_dates(sample, dated(spark, d))


@query
def without_clinic_date(spark, d):
    return validation.without_clinic_date(load(spark, d, "dates_v"))


@query
def date_order_check(spark, d):
    return validation.date_order_check(load(spark, d, "dates_v"))
