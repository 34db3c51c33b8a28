"""Column layouts of the annotation files and of the tables with a header.

The layouts are fixed values: files without a header are read by position, so
names and order must be exactly these.
"""

from pyspark.sql import types as T

S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()

# Tokens that stand for "no value" once surrounding blanks are removed.
NULL_TOKENS = ("", "NA", "null", "NULL")

HEAD = [("Letter", S), ("Start", I), ("End", I), ("CUI", S)]

BIRTH_DAY_MONTH = [("DoBDD", I), ("DoBMD", I)]
DATES = [("DoBYD", I), ("ClinicDD", I), ("ClinicMD", I), ("ClinicYD", I),
         ("LetDD", I), ("LetMD", I), ("LetYD", I)]
IDS = [("Hosp_No", S), ("NHS_No", S), ("PostCode", S)]
PERSON = [("Gender", S), ("Address", S), ("FirstName", S), ("MiddleName", S), ("Surname", S)]

EVENT = [("PREF", S), ("TimePeriod", S), ("NumberOfTimePeriods", D),
         ("LowerNumberOfTimePeriods", D), ("UpperNumberOfTimePeriods", D),
         ("YearDate", I), ("MonthDate", I), ("DayDate", I), ("PointInTime", S),
         ("Age", D), ("AgeLower", D), ("AgeUpper", D), ("AgeUnit", S),
         ("Certainty", I), ("Negation", S), ("Experiencer", S), ("Rule", S)]
STATEMENT = [("PREF", S), ("Negation", S), ("Experiencer", S), ("Certainty", I), ("Rule", S)]

BODIES = {
    "SeizureFrequency": [
        ("String", S), ("FreqChange", S), ("NofS", D), ("LNofS", D), ("UNofS", D), ("TP", S),
        ("NofTP", D), ("LNofTP", D), ("UNofTP", D), ("Sin_Dur", S), ("YD", I), ("MD", I),
        ("DD", I), ("PinT", S), ("Age", D), ("AgeLower", D), ("AgeUpper", D), ("AgeUnit", S),
        ("Certainty", I), ("Negation", S), ("Rule", S)],
    "Diagnosis": [("PREF", S), ("Negation", S), ("DiagCategory", S), ("Certainty", I), ("Rule", S)],
    "BirthHistory": STATEMENT,
    "EpilepsyCause": STATEMENT,
    "Investigations": [
        ("CT_Performed", S), ("CT_Results", S), ("MRI_Performed", S), ("MRI_Results", S),
        ("EEG_Performed", S), ("EEG_Type", S), ("EEG_Results", S), ("Certainty", I),
        ("Negation", S), ("Rule", S)],
    "Onset": EVENT,
    "Prescription": [("DrugName", S), ("DrugDose", D), ("DoseUnit", S), ("Frequency", D),
                     ("String", S), ("Rule", S)],
    "PatientHistory": EVENT,
    "WhenDiagnosed": EVENT,
}
KINDS = tuple(BODIES)

# What the older files do differently.
OLD_SEPARATOR = {"SeizureFrequency": ":", "Investigations": ":", "Prescription": ":"}
OLD_WITHOUT = {"Investigations": {"Certainty"}, "Prescription": {"DoBDD", "DoBMD"}}
OLD_SPARE_LAST = {"Diagnosis", "PatientHistory"}
SPARE = "Last"


def annotation_fields(kind, generation="new"):
    """(name, type) pairs of one annotation file, in file order."""
    if generation == "new":
        return HEAD + BODIES[kind] + BIRTH_DAY_MONTH + DATES + IDS + PERSON
    if generation != "old":
        raise ValueError(f"unknown generation {generation!r}")
    absent = OLD_WITHOUT.get(kind, set())
    fields = [f for f in HEAD + BODIES[kind] + BIRTH_DAY_MONTH + DATES + IDS if f[0] not in absent]
    return fields + [(SPARE, S)] if kind in OLD_SPARE_LAST else fields


def struct(fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


ANNOTATION_SCHEMAS = {
    (kind, generation): struct(annotation_fields(kind, generation))
    for kind in KINDS for generation in ("new", "old")
}

TABLE_SCHEMAS = {
    "letter_list": struct([("SYSTEM_ID", S), ("LETTER", S), ("DOC", S)]),
    "clinic_letter_dates": struct(
        [("SYSTEM_ID", S), ("LETTER", S), ("Clinic_Date", S), ("LetDate", S)]),
    "clinic_dates": struct([("LETTER", S), ("Clinic_Date", S)]),
    "letter_dates": struct([("LETTER", S), ("LetDate", S)]),
    "prescriptions": struct(
        [("SYSTEM_ID", S), ("Letter", S), ("Start", I), ("End", I), ("CUI", S), ("Name", S),
         ("Dose", D), ("Unit", S), ("Frequency", D)]),
    "seizure_frequency": struct(
        [("SYSTEM_ID", S), ("Letter", S), ("Start", I), ("End", I), ("CUI", S),
         ("FreqChange", S), ("NofS", D), ("LNofS", D), ("UNofS", D), ("TP", S), ("NofTP", D),
         ("LNofTP", D), ("UNofTP", D), ("Sin_Dur", S), ("YD", I), ("MD", I), ("DD", I),
         ("PinT", S)]),
    "top_doses": struct([("ASM", S), ("Dose", D)]),
    "seizure_groups": struct([("CUI", S), ("Grouping", S)]),
    "epilepsy_types": struct([("CUI", S), ("EpilepsyType", S)]),
    "trusted": struct([("SYSTEM_ID", S), ("DATE_OF_BIRTH", S), ("NHS_NUMBER", S),
                       ("GENDER_CD", I), ("PostCode", S)]),
    "review_sample": struct([("LETTER", S)]),
}
